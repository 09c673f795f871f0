"""DataFrame operators over items of many sessions."""
