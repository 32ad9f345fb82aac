"""The two search tools' surface for single requests: validation, excerpts, budgets, cursors, projections."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import datetime

from ..functions.text import fold_text, text_tokens

LIMIT, BUDGET, QUERY_BYTES, WINDOW, EXCERPT = (1, 50, 10), (1024, 65536, 16384), 8192, (0, 10, 2), 640
AGENTS = ("codex", "claude", "copilot")
COMMON = {"mode", "query", "limit", "budget", "match_id", "cursor"}
PROJECT_ONLY, SESSION_ONLY = {"path_glob"}, {"agent", "session_id", "after", "before", "window_before", "window_after"}
BY_MODE = {"search": set(), "context": {"query", "path_glob", "agent", "session_id", "after", "before", "limit"}, "copies": {"query", "path_glob", "agent", "session_id", "after", "before", "window_before", "window_after"}}


class InvalidArguments(ValueError):
    pass


def within(args: dict, name: str, low: int, high: int, default: int) -> int:
    value = args.get(name, default)
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise InvalidArguments(f"{name} must be {low} to {high}")
    return value


def parse_time(value: str) -> datetime:
    try:
        found = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (ValueError, AttributeError) as e:
        raise InvalidArguments(f"not a time: {value}") from e
    if found.tzinfo is None:
        raise InvalidArguments(f"a time needs a zone: {value}")
    return found


def validated(kind: str, args: dict) -> dict:
    """Arguments with defaults; raises InvalidArguments for unknown, forbidden or bad ones."""
    known = COMMON | (PROJECT_ONLY if kind == "project" else SESSION_ONLY)
    if unknown := set(args) - known:
        raise InvalidArguments(f"unknown: {', '.join(sorted(unknown))}")
    mode = args.get("mode", "search")
    if mode not in (("search",) if kind == "project" else BY_MODE):
        raise InvalidArguments(f"mode: {mode}")
    if forbidden := {a for a in BY_MODE[mode] if args.get(a) is not None}:
        raise InvalidArguments(f"not with mode {mode}: {', '.join(sorted(forbidden))}")
    out = dict(args, mode=mode, limit=within(args, "limit", *LIMIT), budget=within(args, "budget", *BUDGET))
    if mode == "search":
        if not 1 <= len((args.get("query") or "").encode()) <= QUERY_BYTES or not args["query"].strip():
            raise InvalidArguments(f"query must be 1 to {QUERY_BYTES} bytes")
        if args.get("agent") is not None and args["agent"] not in AGENTS:
            raise InvalidArguments(f"agent: {args['agent']}")
        times = [parse_time(args[t]) for t in ("after", "before") if args.get(t) is not None]
        if len(times) == 2 and not times[0] < times[1]:
            raise InvalidArguments("after must be earlier than before")
    elif not args.get("match_id"):
        raise InvalidArguments("match_id is needed")
    if mode == "context":
        for side in ("window_before", "window_after"):
            out[side] = within(args, side, *WINDOW)
    return out


@dataclass(frozen=True)
class Cursor:
    mode: str
    anchor: str
    generation: int
    at: tuple[int, ...]

    def text(self) -> str:
        return json.dumps([self.mode, self.anchor, self.generation, *self.at], separators=(",", ":"))

    @staticmethod
    def parse(text: str, mode: str, anchor: str, generation: int) -> Cursor:
        """Expires when the generation has changed."""
        try:
            m, a, g, *at = json.loads(text)
        except ValueError as e:
            raise InvalidArguments("bad cursor") from e
        if (m, a) != (mode, anchor) or not at or not all(isinstance(x, int) and x >= 0 for x in at):
            raise InvalidArguments("bad cursor")
        if g != generation:
            raise InvalidArguments("cursor_expired")
        return Cursor(m, a, g, tuple(at))


def phrase_place(folded: str, runs: list[str]) -> int:
    """Where the query's words follow one another with only other characters than alphanumerics between; -1 if nowhere."""
    if len(runs) < 2:
        return -1
    m = re.search(r"(?:(?![^\W_]).)*".join(map(re.escape, runs)), folded, re.DOTALL)
    return m.start() if m else -1


def excerpt_window(text: str, query: str, most: int = EXCERPT) -> tuple[int, str]:
    """(byte offset, excerpt of at most ``most`` bytes), a third of it before the best place.

    The best place is the whole query, else its words as a phrase, else its longest term that occurs.
    """
    raw = text.encode()
    if len(raw) <= most:
        return 0, text
    folded, origin, at = [], [], 0
    for c in text:
        f = fold_text(c)
        folded.append(f)
        origin += [at] * len(f)
        at += len(c.encode())
    body, asked = "".join(folded), fold_text(query)
    found = body.find(asked) if asked else -1
    if found < 0:
        found = phrase_place(body, [fold_text(r) for r in re.findall(r"\w+", query)])
    if found < 0:
        terms = sorted(dict.fromkeys([asked, *text_tokens(query)]), key=lambda t: -len(t.encode()))
        found = next((p for t in terms if t and (p := body.find(t)) >= 0), -1)
    centre = origin[found] if found >= 0 else 0
    start = min(max(0, centre - most // 3), len(raw) - most)
    while raw[start] & 0xC0 == 0x80:
        start -= 1
    end = min(start + most, len(raw))
    while end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, raw[start:end].decode()


def fitted(response: dict, budget: int, query: str) -> dict:
    """Results are dropped from the end, then the last one's excerpt halved, until the response fits."""
    size = lambda: len(json.dumps(response, ensure_ascii=False, separators=(",", ":")).encode())
    while size() > budget:
        response["truncated"] = True
        results = response["results"]
        if not results:
            raise InvalidArguments("response_budget_too_small")
        excerpt = results[0].get("excerpt", "")
        if len(results) > 1 or len(excerpt.encode()) <= 32:
            results.pop()
            continue
        offset, shorter = excerpt_window(excerpt, query, len(excerpt.encode()) // 2)
        results[0] |= {"excerpt": shorter, "excerpt_byte_offset": results[0].get("excerpt_byte_offset", 0) + offset, "excerpt_truncated": True}
    return response


def public_hit(hit: dict, kind: str, query: str) -> dict:
    """What a client sees of a hit."""
    offset, excerpt = excerpt_window(hit["text"], query)
    out = {k: hit.get(k) for k in (("match_id", "path", "score") if kind == "project" else ("match_id", "agent", "session_id", "event_id", "timestamp", "role", "tool", "copy_count", "score"))}
    if kind == "session":
        out["event_kind"] = hit.get("field_kind") or ("tool" if hit.get("tool") else "message")
    return out | {"excerpt": excerpt, "excerpt_byte_offset": offset, "excerpt_truncated": excerpt != hit["text"]}
