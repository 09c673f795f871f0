"""JSON requests and responses, one a line, over sessions of a store."""

from __future__ import annotations

import json
from typing import IO

from pyspark.sql import functions as F

from .schema import Config, Model
from .session import Session
from .sources import jsonl
from .sources.store import Store


class Server:
    """Answers ``session.start``, ``context.add``, ``context.plan``, ``context.compact``, ``context.materialize`` and ``context.stats``."""

    def __init__(self, store: Store, config: Config | None = None, session_id: str = "default"):
        self.store, self.config = store, config or Config()
        self.session_id, self._session = session_id, None

    @property
    def session(self) -> Session:
        if self._session is None:
            self._session = Session(self.store, self.session_id, self.config)
        return self._session

    def answer(self, line: str) -> dict | None:
        """The response to a line; None for a blank one. A malformed line gets an error with request_id ``unknown``."""
        if not line.strip():
            return None
        try:
            request = json.loads(line)
            if not isinstance(request, dict):
                raise ValueError("not an object")
        except ValueError as e:
            return {"type": "error", "request_id": "unknown", "message": str(e)}
        number = request.get("request_id")
        try:
            return {"request_id": number} | self._handle(request)
        except Exception as e:  # the loop goes on after a failed request
            return {"type": "error", "request_id": number or "unknown", "message": str(e).splitlines()[0] if str(e) else type(e).__name__}

    def _handle(self, request: dict) -> dict:
        kind, extra = request.get("type"), int(request.get("predicted_extra_tokens") or 0)
        if kind == "session.start":
            m = request["model"]
            model = Model(m["name"], int(m["context_window"]), int(m.get("reserved_output_tokens") or 0) or self.config.reserve.output_tokens)
            self.session_id = request["session_id"]
            self._session = Session(self.store, self.session_id, self.config, model)
            return {"type": "ok"}
        if kind == "context.add":
            lines = self.store.spark.createDataFrame([(json.dumps(request["item"]),)], "value string")
            self.session.ingest(jsonl.records(lines, F.lit(self.session_id)), adapter="stdio")
            return {"type": "ok"}
        if kind == "context.plan":
            actions, header = self.session.plan(extra)
            return {"type": "plan", "plan": header.first().asDict() | {"actions": [r.asDict(True) for r in actions.orderBy("idx").collect()]}}
        if kind in ("context.compact", "context.materialize"):
            rows = (self.session.compact if kind == "context.compact" else self.session.materialize)(extra)
            items = [r.asDict() for r in rows.collect()]
            return {"type": "working_set", "items": items, "total_tokens": sum(i["token_count"] for i in items)}
        if kind == "context.stats":
            row = self.session.status(extra).drop("candidates", "model").first()
            stats = row.asDict(True) if row else {"session_id": self.session_id}
            if "composition" in stats:
                stats["composition"] = [[c["kind"], c["tokens"]] for c in stats["composition"]]
            return {"type": "stats", "stats": stats}
        raise ValueError(f"unknown request type {kind!r}")

    def serve(self, source: IO[str], sink: IO[str]) -> None:
        for line in source:
            if (response := self.answer(line)) is not None:
                sink.write(json.dumps(response, default=str) + "\n")
                sink.flush()
