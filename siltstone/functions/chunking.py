"""Functions over texts that columns can't express well, as plain Python; the UDFs beside them take whole columns."""

from __future__ import annotations

import json
import re


def border_lengths(previous: str, current: str) -> list[int]:
    """Lengths of suffixes of one text that are prefixes of the next, longest first."""
    pattern: list[str | None] = [*current, None, *previous[-len(current) :]] if current else []  # None: equal to no character
    fail = [0] * len(pattern)
    for i in range(1, len(pattern)):
        k = fail[i - 1]
        while k and pattern[i] != pattern[k]:
            k = fail[k - 1]
        fail[i] = k + (pattern[i] == pattern[k])
    out, k = [], fail[-1] if pattern else 0
    while k:
        out.append(k)
        k = fail[k - 1]
    return out


def split_symbol(body: str, primary: str, continuation: str, most_tokens: int = 512) -> list[str]:
    """Blank-line blocks packed in order into pieces of so many tokens, headers included; a larger block is cut by its lines, and a larger line by its words."""

    def parts(block: str, room: int) -> list[str]:
        if len(block.split()) <= room:
            return [block]
        lines = block.split("\n")
        if len(lines) > 1:
            return [p for line in lines if line.strip() for p in parts(line, room)]
        words = block.split()
        return [" ".join(words[i : i + room]) for i in range(0, len(words), room)]

    head = max(len(primary.split()), len(continuation.split()))
    blocks = [p for b in re.split(r"\n\s*\n", body) if b.strip() for p in parts(b, max(1, most_tokens - head))]
    out: list[list[str]] = []
    used = 0
    for block in blocks:
        size = len(block.split())
        if out and used + size <= most_tokens:
            out[-1].append(block)
            used += size
        else:
            out.append([block])
            used = len((continuation if len(out) > 1 else primary).split()) + size
    return [(primary if i == 0 else continuation) + "\n" + "\n\n".join(piece) for i, piece in enumerate(out)]


def segment_session(turns: list[tuple[str, str, bool]], budget: int, most: int = 16) -> tuple[list[list[int]], bool]:
    """Turn numbers of each segment, the last `most` of them, and whether some were left out.

    turns: role, text, and whether a compaction ends there. A segment ends with a compaction, before the
    user's turn that would exceed the budget, or before any turn that would exceed half as much again.
    """
    out: list[list[int]] = [[]]
    size = 0
    for i, (role, text, compacted) in enumerate(turns):
        over = size + len(text)
        if out[-1] and (over > budget and role == "user" or over > 1.5 * budget):
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(text)
        if compacted:
            out.append([])
            size = 0
    out = [s for s in out if s]
    return out[-most:], len(out) > most


def render_session(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Turns as text, and each one's (offset, first line)."""
    parts, spans, offset, line = [], [], 0, 1
    for role, text in turns:
        part = f"{role.upper()}: {text}\n"
        spans.append((offset, line))
        parts.append(part)
        offset += len(part)
        line += part.count("\n")
    return "".join(parts), spans


def repair_json(text: str) -> object | None:
    """A cut-off JSON value with its open strings, arrays and objects closed; None if that isn't enough.

    One pass keeps what is open after each character; the longest beginning that closes well is sought
    among the places where a value can end, of the last 200.
    """
    stack, string, escaped = "", False, False
    places: list[tuple[int, str, bool]] = []
    for i, ch in enumerate(text):
        if string:
            escaped, string = (False, True) if escaped else (ch == "\\", ch != '"')
        elif ch == '"':
            string = True
        elif ch in "[{":
            stack = ("]" if ch == "[" else "}") + stack
        elif ch in "]}" and stack:
            stack = stack[1:]
        if len(text) - i <= 201:
            places.append((i + 1, stack, string))
    for end, closing, inside in reversed(places):
        candidate = re.sub(r",\s*$", "", text[:end].rstrip() + ('"' if inside else "")) + closing
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    return None


def fit_response(items: list[dict], target: int, hard: int) -> list[dict]:
    """Results cut to a size in bytes as JSON: the longest contents are halved, the least first, then the last results go."""
    items = [dict(i) for i in items]

    def size() -> int:
        return len(json.dumps(items).encode())

    for i in range(len(items) - 1, -1, -1):
        while size() > target and len(items[i].get("content") or "") > 200:
            items[i]["content"] = items[i]["content"][: len(items[i]["content"]) // 2]
    while items and size() > hard:
        items.pop()
    return items


def topic_overlaps(why: str, titles: list[str], least: int = 2) -> bool:
    """Whether a reason shares some content words with one of the titles; slugs with digits don't count."""

    def words(text: str) -> set[str]:
        return {w for w in re.findall(r"[a-z]{3,}", re.sub(r"\S*\d\S*", " ", text.lower()))}

    return any(len(words(why) & words(t)) >= least for t in titles)


def bisect_batches(inputs: list, embed) -> tuple[dict[int, object], list[int]]:
    """Embeds a list, halving batches that fail until what can't be embedded stands alone: (results, failed places)."""
    done: dict[int, object] = {}
    failed: list[int] = []
    todo = [list(range(len(inputs)))]
    while todo:
        places = todo.pop()
        if not places:
            continue
        try:
            done.update(zip(places, embed([inputs[i] for i in places]), strict=True))
        except Exception:
            if len(places) == 1:
                failed.append(places[0])
            else:
                half = len(places) // 2
                todo += [places[half:], places[:half]]
    return done, sorted(failed)
