"""What changed between two states of a file: the smallest replacement, private spans of new text, patches, changes from outside;
and what a file will be once a tool has written it, edited it or patched it.

Cases: null texts give nulls; equal texts have no replacement; empty texts are whole insertions or deletions; of a file to be
edited or patched a null text means that there is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("placeholder", pa.string()), ("original", pa.string())])
SECTION = pa.struct([("type", pa.string()), ("path", pa.string()), ("body", pa.list_(pa.string()))])


def _shared(a: str, b: str, most: int, at_end: bool) -> int:
    """How many characters two texts share at their beginning or end, ``most`` at most, by halving."""
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        same = a[len(a) - mid : len(a) - low] == b[len(b) - mid : len(b) - low] if at_end else a[low:mid] == b[low:mid]
        low, high = (mid, high) if same else (low, mid - 1)
    return low


def smallest_replacement(before: str, after: str) -> tuple[int, int, str] | None:
    """start, end and inserted text of the one replacement that makes ``after`` of ``before``: the beginning they share stays
    as long as can be, then the end; None if nothing changed."""
    if before == after:
        return None
    room = min(len(before), len(after))
    start = _shared(before, after, room, False)
    tail = _shared(before, after, room - start, True)
    return start, len(before) - tail, after[start : len(after) - tail]


def _with(df: DataFrame, columns: list[str], made, kinds: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """``df`` with columns that a function of one row's ``columns`` makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [made(*row) for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)]
            new = [pa.array([r[k] for r in out], kind) for k, (_, kind, _) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(n for n, _, _ in kinds)])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"{n} {sql}" for n, _, sql in kinds]
    return df.mapInArrow(run, ", ".join(fields))


def replacements(df: DataFrame, before: str, after: str) -> DataFrame:
    """``df`` with start, end, inserted of the smallest replacement between two text columns; nulls where nothing changed."""
    made = lambda a, b: (smallest_replacement(a, b) if a is not None and b is not None else None) or (None, None, None)
    return _with(df, [before, after], made, [("start", pa.int32(), "int"), ("end", pa.int32(), "int"), ("inserted", pa.string(), "string")])


def private_spans(df: DataFrame, text: str, session: str) -> DataFrame:
    """``df`` with ``spans`` (start, end, placeholder, original): where a text holds originals of a session, whatever their case.

    ``session``: array of placeholder and original; of originals that begin at a place the longest counts.
    """

    def made(value: str | None, entries: list | None):
        if value is None:
            return (None,)
        known = sorted(((e["original"], e["placeholder"]) for e in entries or () if e["original"]), key=lambda x: -len(x[0]))
        if not known:
            return ([],)
        names = {o.lower(): p for o, p in reversed(known)}
        found = re.finditer("|".join(re.escape(o) for o, _ in known), value, re.IGNORECASE)
        return ([{"start": m.start(), "end": m.end(), "placeholder": names.get(m[0].lower()), "original": m[0]} for m in found],)

    return _with(df, [text, session], made, [("spans", pa.list_(SPAN), "array<struct<start:int,end:int,placeholder:string,original:string>>")])


_HEAD = re.compile(r"\*\*\* (Add|Update|Delete) File: (.+)")


def _safe(path: str) -> bool:
    """Whether a path stays in its folder: relative, without a drive, and no step of it empty, a dot or two."""
    steps = path.replace("\\", "/").split("/")
    return "\0" not in path and not re.match(r"[A-Za-z]:[\\/]", path) and not any(step in ("", ".", "..") for step in steps)


def patch_sections(text: str | None) -> list[dict] | None:
    """Type, path and body lines of each file of a patch, or None if it is not one: it begins and ends with its marks, each
    section has a header, and no path is unsafe or comes twice."""
    lines = (text or "").replace("\r\n", "\n").rstrip("\n").split("\n")
    if len(lines) < 3 or lines[0] != "*** Begin Patch" or lines[-1] != "*** End Patch":
        return None
    out: list[dict] = []
    for line in lines[1:-1]:
        if line.startswith("*** "):
            head = _HEAD.fullmatch(line)
            if not head or not _safe(head[2]) or any(s["path"] == head[2] for s in out):
                return None
            out.append({"type": head[1].lower(), "path": head[2], "body": []})
        elif not out:
            return None
        else:
            out[-1]["body"].append(line)
    return out


def patches(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``sections`` of a patch column; null where it is no patch."""
    return _with(df, [column], lambda x: (patch_sections(x),), [("sections", pa.list_(SECTION), "array<struct<type:string,path:string,body:array<string>>>")])


def replaced(text: str, old: str, new: str, every: bool) -> tuple[str | None, str | None]:
    """``text`` with one or every ``old`` as ``new``, or why not: the one place must be the only one."""
    found = text.count(old) if old else 0
    if not found:
        return None, "NOT_FOUND" if old else "EMPTY_SEARCH"
    if found > 1 and not every:
        return None, "AMBIGUOUS"
    return text.replace(old, new), None


def _lines(lines: list[str]) -> str:
    return "".join(line + "\n" for line in lines)


def patched(text: str | None, kind: str, body: list[str]) -> tuple[str | None, str | None]:
    """A file after a section of a patch (None: it is gone), or why the section does not apply.

    A hunk's old lines must be found once in what the hunks before it left; a hunk without old lines has no place.
    """
    if kind == "add":
        if text is not None:
            return None, "EXISTS"
        return (None, "BAD_LINE") if any(line[:1] != "+" for line in body) else (_lines([line[1:] for line in body]), None)
    if text is None:
        return None, "ABSENT"
    if kind == "delete":
        return None, None
    heads = [k for k, line in enumerate(body) if line.startswith("@@")]
    if not heads or heads[0]:
        return None, "NO_HUNK"
    for head, end in zip(heads, [*heads[1:], len(body)]):
        hunk = [line for line in body[head + 1 : end] if line != "\\ No newline at end of file"]
        if any(line[:1] not in ("+", "-", " ") or not line for line in hunk):
            return None, "BAD_LINE"
        old, new = (_lines([line[1:] for line in hunk if line[0] in marks]) for marks in (" -", " +"))
        text, error = replaced(text, old, new, False)
        if text is None:
            return None, error
    return text, None


EDIT = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("inserted_length", pa.int32())])


_PREDICTION = [
    ("next", pa.string(), "string"),
    ("operation", pa.string(), "string"),
    ("source_length", pa.int32(), "int"),
    ("next_length", pa.int32(), "int"),
    ("edits", pa.list_(EDIT), "array<struct<start:int,end:int,inserted_length:int>>"),
    ("error_code", pa.string(), "string"),
]


def _compact(before: str, after: str) -> list[dict]:
    found = smallest_replacement(before, after)
    return [{"start": found[0], "end": found[1], "inserted_length": len(found[2])}] if found else []


def predicted(df: DataFrame, text: str, kind: str, content: str, edits: str) -> DataFrame:
    """``df`` with what a tool will make of a file: next, operation, source_length, next_length, edits, error_code.

    ``kind``: 'write' makes ``content`` the file; 'edit' does the one edit of ``edits`` (array of old_text, new_text, every),
    'multi_edit' all of them in turn.  The edits of the result are places in the old text: each place of a single edit, the
    smallest replacement of several; next_length is source_length with them taken out and put in.  Where an edit has no place,
    or several and is not for every one, or nothing would change, there is an error_code and no next.
    """

    def made(before: str | None, what: str | None, whole: str | None, asked: list | None) -> tuple:
        fail = lambda code: (None, None, None, None, None, code)
        if what == "write":
            return fail("NO_CONTENT") if whole is None else (whole, "write_file", len(before or ""), len(whole), [], None)
        if what not in ("edit", "multi_edit") or not asked or (what == "edit" and len(asked) != 1):
            return fail("UNSUPPORTED")
        if before is None:
            return fail("ABSENT")
        now = before
        for e in asked:
            if e is None or e["old_text"] is None or e["new_text"] is None:
                return fail("UNSUPPORTED")
            now, error = replaced(now, e["old_text"], e["new_text"], bool(e["every"]))
            if now is None:
                return fail(error)
        if what == "edit":
            old, new = asked[0]["old_text"], asked[0]["new_text"]
            places = [{"start": m.start(), "end": m.end(), "inserted_length": len(new)} for m in re.finditer(re.escape(old), before)]
        else:
            places = _compact(before, now)
        return (now, "replace_in_file", len(before), len(now), places, None) if places else fail("UNCHANGED")

    return _with(df, [text, kind, content, edits], made, _PREDICTION)


def apply_patches(patches: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """What patches make of files: key, path, type, next, operation, source_length, next_length, edits, error_code, applied.

    ``patches``: key, patch; ``files``: key, path, text, where no path comes twice in a key.  There is a row a section, in no
    order, and one without a path for what is no patch (NOT_A_PATCH).  A patch applies as a whole or not at all: if a section
    has an error, no section of that row's patch is applied.  Sections that change nothing are UNCHANGED in ``operation``.
    A key that comes twice in ``patches`` is two patches.
    """
    rows = patches.select(F.col(key), "patch", F.sha2("patch", 256).alias("_n"))
    parsed = _with(rows, ["patch"], lambda x: (patch_sections(x),), [("sections", pa.list_(SECTION), "array<struct<type:string,path:string,body:array<string>>>")])
    flat = parsed.select(key, F.explode_outer("sections").alias("s"), "_n").select(F.col(key), F.col("s.type").alias("type"), F.col("s.path").alias("path"), F.col("s.body").alias("body"), "_n")
    there = flat.join(files.select(key, "path", "text"), [key, "path"], "left")

    def made(text: str | None, kind: str | None, body: list | None) -> tuple:
        if kind is None:
            return None, None, None, None, None, "NOT_A_PATCH"
        after, error = patched(text, kind, body or [])
        if error:
            return None, None, None, None, None, error
        if after == text:
            return after, "UNCHANGED", len(text or ""), len(after or ""), [], None
        if text is None or after is None:
            return after, "write_file", len(text or ""), len(after or ""), [], None
        return after, "apply_patch", len(text), len(after), _compact(text, after), None

    done = _with(there, ["text", "type", "body"], made, _PREDICTION)
    # the sections of one patch are one value of the input, so a window holds no more than that
    applied = F.count("error_code").over(Window.partitionBy(key, "_n")) == 0
    return done.select(F.col(key), "path", "type", "next", "operation", "source_length", "next_length", "edits", "error_code", applied.alias("applied"))


def reconciled(changes: DataFrame, plans: DataFrame, key: str) -> DataFrame:
    """Files that changed outside (key, old_hash, new_hash) with ``status``, and whether the stored plan of the new content can
    be used (``plan_reuse``) and one of the old content is at hand (``has_previous``).  ``plans``: content_hash."""
    known = plans.select("content_hash").distinct()
    side = lambda name, flag: known.select(F.col("content_hash").alias(name), F.lit(True).alias(flag))
    rows = changes.select(key, "old_hash", "new_hash").join(side("new_hash", "_new"), "new_hash", "left").join(side("old_hash", "_old"), "old_hash", "left")
    status = F.when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return rows.select(key, status.alias("status"), F.coalesce("_new", F.lit(False)).alias("plan_reuse"), F.coalesce("_old", F.lit(False)).alias("has_previous"))
