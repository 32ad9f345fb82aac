"""The two search tools over a published index: search, context and copies, within a byte budget.

One request is a small job: what comes to the driver is bounded by the request's limit
or window. Cursors hold as long as the index's generation.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import sessions as N
from ..operators.coverage import PUBLIC
from ..operators.published import Index, with_columns
from .api import Cursor, InvalidArguments, excerpt_window, fitted, public_hit, validated
from .ranked import Query, search

PAGE = 32


def normal_time(value: str | None) -> str | None:
    """RFC 3339 in UTC with milliseconds, as timestamps are stored."""
    from datetime import UTC

    from .api import parse_time

    return None if value is None else parse_time(value).astimezone(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def size(response: dict) -> int:
    return len(json.dumps(response, ensure_ascii=False, separators=(",", ":")).encode())


def public_coverage(coverage: dict) -> dict:
    """Counts only; diagnostics of other categories than the public ones are summed as ``other``."""
    diagnostics: dict[str, int] = {}
    for category, n in (coverage.get("diagnostics") or {}).items():
        name = category if category in PUBLIC else "other"
        diagnostics[name] = diagnostics.get(name, 0) + n
    return {k: coverage.get(k) for k in ("reconciled_at", "pending", "excluded", "errors")} | {"diagnostics": diagnostics}


class Tools:
    def __init__(self, index: Index, collection: str, status: str = "ready", coverage: dict | None = None, eligible: bool = True) -> None:
        self.index, self.collection, self.status, self.coverage, self.eligible = index, collection, status, coverage or {}, eligible
        self.chunks = with_columns(index.chunks).where((F.col("collection") == collection) & F.col("eligible"))

    def call(self, tool: str, args: dict, now: str | None = None, options: R.Options = R.Options()) -> dict:
        """``tool``: search_project or search_sessions. Raises InvalidArguments."""
        if tool not in ("search_project", "search_sessions"):
            raise InvalidArguments("unknown_tool")
        kind = "project" if tool == "search_project" else "session"
        a = validated(kind, args)
        response = {"status": self.status, "generation": self.index.generation, "coverage": public_coverage(self.coverage), "truncated": False}
        if a["mode"] == "search":
            return self.found(kind, a, response | {"results": []}, now, options)
        return (self.around if a["mode"] == "context" else self.copies)(a, response)

    def found(self, kind: str, a: dict, response: dict, now: str | None, options: R.Options) -> dict:
        if self.eligible:
            asked = Query(1, a["query"], self.collection, kind, a.get("path_glob"), a.get("agent"), a.get("session_id"), normal_time(a.get("after")), normal_time(a.get("before")))
            hits = search(self.index, [asked], options, now, a["limit"]).hits.select("match_id", "position", "score", "copy_count")
            rows = hits.join(self.chunks, "match_id").orderBy("position").collect()  # at most ``limit``
            response["results"] = [public_hit(r.asDict(), kind, a["query"]) for r in rows]
        return fitted(response, a["budget"], a["query"])

    def around(self, a: dict, response: dict) -> dict:
        """The chunks of the events around a match, page by page; a chunk that does not fit is cut and goes on."""
        if not self.eligible:
            raise InvalidArguments("source_changed: reconciliation is pending")
        anchor, generation = a["match_id"], self.index.generation
        at, byte = Cursor.parse(a["cursor"], "context", anchor, generation).at[:2] if a.get("cursor") else (0, 0)
        rows = N.context(self.chunks, self.chunks.where(F.col("match_id") == anchor).select("match_id"), a["window_before"], a["window_after"])
        page = rows.orderBy("ordinal").offset(at).limit(PAGE + 1).collect()
        if at and not page:
            raise InvalidArguments("match_expired: the cursor is outside the window")
        response["context"] = []
        for k, r in enumerate(page[:PAGE]):
            raw = (r.text or "").encode()[byte if k == 0 else 0 :]
            start = byte if k == 0 else 0
            item = public_hit(r.asDict() | {"score": None, "copy_count": 1}, "session", "") | {"excerpt": raw.decode(), "excerpt_byte_offset": start, "excerpt_truncated": False}
            response["context"].append(item)
            cursor = lambda *place: Cursor("context", anchor, generation, place).text()
            more = k + 1 < len(page)
            if size(response | ({"cursor": cursor(at + k + 1, 0)} if more else {})) <= a["budget"]:
                continue
            response["truncated"] = True
            if k:
                response["context"].pop()
                return response | {"cursor": cursor(at + k, 0)}
            while len(raw) > 1:
                raw = raw[: len(raw) // 2]
                while raw and raw.decode(errors="ignore").encode() != raw:
                    raw = raw[:-1]
                item |= {"excerpt": raw.decode(), "excerpt_truncated": True}
                out = response | {"cursor": cursor(at, start + len(raw))}
                if raw and size(out) <= a["budget"]:
                    return out
            raise InvalidArguments("response_budget_too_small")
        return response | ({"cursor": Cursor("context", anchor, generation, (at + PAGE, 0)).text(), "truncated": True} if len(page) > PAGE else {})

    def copies(self, a: dict, response: dict) -> dict:
        """Where the same event stands elsewhere, page by page."""
        response["copies"] = []
        if not self.eligible:
            return response
        anchor, generation = a["match_id"], self.index.generation
        (at,) = Cursor.parse(a["cursor"], "copies", anchor, generation).at[:1] if a.get("cursor") else (0,)
        page = N.copies_of(self.chunks, anchor, at, a["limit"] + 1).select("match_id", "timestamp", "path", "start_line", "end_line").collect()
        if at and not page:
            raise InvalidArguments("match_expired: the cursor is outside the group")
        for k, r in enumerate(page[: a["limit"]]):
            response["copies"].append(r.asDict())
            more = {"cursor": Cursor("copies", anchor, generation, (at + k + 1,)).text(), "truncated": True} if k + 1 < len(page) else {}
            if size(response | more) > a["budget"]:
                response["copies"].pop()
                if not response["copies"]:
                    raise InvalidArguments("response_budget_too_small")
                return response | {"cursor": Cursor("copies", anchor, generation, (at + k,)).text(), "truncated": True}
        return response | more if page else response


__all__ = ["Tools", "excerpt_window"]
