"""Errors of the engine: a kind, and the code that a caller of that kind of request sees."""

from __future__ import annotations


class EngineError(Exception):
    """kind names what went wrong; code is the request's error code, if it has one."""

    def __init__(self, kind: str, message: str = "", code: str | None = None):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind, self.code = kind, code


class ParseError(EngineError):
    """The source text isn't a request."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(kind, message, "RF1001")


class IrError(EngineError):
    """A request or its bytes break the rules of the intermediate form."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(kind, message, "RF1004" if kind == "UnsupportedVersion" else "RF1003")


class BindError(EngineError):
    """A request doesn't fit the catalog."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(kind, message, "RF1002")


class Canceled(EngineError):
    def __init__(self):
        super().__init__("Canceled", "", "RF1006")


#: Codes of rejected writes by request.
WRITE_CODES = {"document_insert": "DF1001", "graph_add_node": "GF1001", "graph_add_edge": "GF1002", "kv_put": "KV1001", "observe": "EV1002", "read_evidence_payload": "EV1004"}
