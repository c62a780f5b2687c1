"""JSON records whose fields drift from file to file: report and unify.

Files of a feed are compared with their predecessors.  Every file is profiled
once: each field path gets its type and a min-wise value sketch of fixed size,
built only from records that both files of a pair contain.  Fields that went and
fields that came are then matched per pair of parents with an optimal bipartite
assignment over sketch similarity (names only break ties), which gives the
renames; what stays unmatched was removed or added.  A sketch only proposes a
rename of fields without fields below: all their values in the shared records
must agree (count and exclusive or of the distinct key-and-value hashes).

Scale: one pass flattens the records and counts fields inside each Arrow batch.
Values are only looked at of fields that one file of a pair lacks, and only in
the records that both files hold: these lines alone are read a second time.  The
rest is a hash aggregation over (field, register) with map-side combining, in
which a field is a 64-bit hash of its file and path.  What reaches one task
afterwards is the schema of two files, never their rows.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.scratch import stage

REGISTERS = 64
#: Numbers from here on stand for no register: for every value hash itself (towards the next file, towards the previous
#: one), later for their exclusive or; two further on for how many there are.
EXACT = 2 * REGISTERS
#: Least share of equal sketch registers at which two fields may be one renamed field.
SAME_VALUES = 0.6

CHANGE_SCHEMA = "feed string, file_no int, change_kind string, old_path string, new_path string"
_FIELDS = "feed string, file_no int, path string, kind string, n bigint"
_SKETCHES = "of bigint, reg int, mins bigint"


def kind_of(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    return "array" if isinstance(value, list) else "number"


def read_object(payload: str | None) -> dict | None:
    """The JSON object in ``payload``, or None if it isn't a readable one."""
    try:
        found = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def walk(value: object, path: str, out: dict[str, tuple[str, list[str]]]) -> list[str]:
    """Collect ``path -> (type, scalar texts at and below it)``; gives the texts below ``value``."""
    if isinstance(value, dict):
        texts: list[str] = []
        for name, inner in value.items():
            if inner is not None:
                below = walk(inner, p := f"{path}.{name}" if path else name, out)
                seen = out.setdefault(p, (kind_of(inner), []))
                seen[1].extend(below)
                texts += below
        return texts
    if isinstance(value, list):
        return [t for x in value if x is not None for t in walk(x, path + "[]" if isinstance(x, dict) else path, out)]
    return [json.dumps(value)]


def paths(value: object, path: str, out: dict[str, str]) -> None:
    """Collect ``path -> type`` of what :func:`walk` finds, without the values."""
    if isinstance(value, dict):
        for name, inner in value.items():
            if inner is not None:
                p = f"{path}.{name}" if path else name
                out.setdefault(p, kind_of(inner))
                if isinstance(inner, (dict, list)):
                    paths(inner, p, out)
    else:
        for x in value:
            if isinstance(x, (dict, list)):
                paths(x, path + "[]" if isinstance(x, dict) else path, out)


def _field_id(feed: str, file_no: int, path: str, kind: str) -> int:
    return xxhash.xxh64_intdigest(f"{feed}\0{file_no}\0{path}\0{kind}") - (1 << 63)


def _fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fields of files with the numbers of their records so far; a path of no name counts the file's records."""
    for batch in batches:
        counts: Counter = Counter()
        for feed, file_no, payload in zip(batch.feed, batch.file_no, batch.payload):
            record = read_object(payload)
            if record is not None:
                kinds: dict[str, str] = {}
                paths(record, "", kinds)
                counts.update((feed, file_no, *field) for field in kinds.items())
                counts[feed, file_no, "", "object"] += 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["feed", "file_no", "path", "kind", "n"])


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Register minima and value hashes of the fields asked for, which are named by a hash only."""
    for batch in batches:
        mins: dict[tuple[int, int], int] = {}
        values: set[tuple[int, int, int]] = set()
        for feed, file_no, payload, before, after, wanted in zip(batch.feed, batch.file_no, batch.payload, batch.in_previous, batch.in_next, batch.paths):
            record = read_object(payload)
            if record is None:
                continue
            out: dict[str, tuple[str, list[str]]] = {}
            walk(record, "", out)
            key = str(record.get("record_key"))
            for path in wanted:
                kind, texts = out.get(path, ("", ()))
                field = _field_id(feed, file_no, path, kind)
                for text in texts:
                    h = xxhash.xxh64_intdigest(f"{key}\0{text}") >> 1
                    # registers towards the next file come first, those towards the previous one after them
                    for base, used in ((0, after), (REGISTERS, before)):
                        k = (field, base + h % REGISTERS)
                        if used and h < mins.get(k, 1 << 63):
                            mins[k] = h
                        if used:
                            values.add((field, EXACT + (base > 0), h))
        yield pd.DataFrame([*((f, r, m) for (f, r), m in mins.items()), *values], columns=["of", "reg", "mins"]).astype({"of": "int64", "reg": "int32", "mins": "int64"})


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of registers, of those set on either side, that hold the same value."""
    union = a.keys() | b.keys()
    return sum(a.get(r) == b.get(r) for r in union) / len(union) if union else 0.0


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_")


def name_likeness(a: str, b: str) -> float:
    pairs = [{(" " + plain_name(x) + " ")[i : i + 2] for i in range(len(plain_name(x)) + 1)} for x in (a, b)]
    return len(pairs[0] & pairs[1]) / max(1, len(pairs[0] | pairs[1]))


def assign(score: list[list[float]]) -> list[int]:
    """Optimal assignment (most total score) of rows to columns; -1 where a row stays free.

    Shortest augmenting paths with potentials, O(n^3).
    """
    n = max(len(score), len(score[0]) if score else 0)
    cost = [[-(score[i][j] if i < len(score) and j < len(score[0]) else 0.0) for j in range(n)] for i in range(n)]
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)
    for row in range(n):
        match[n], j = row, n
        least, came, done = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while match[j] != n:
            done[j], i = True, match[j]
            delta, nxt = float("inf"), -1
            for k in range(n):
                if not done[k]:
                    reduced = cost[i][k] - u[i] - v[k]
                    if reduced < least[k]:
                        least[k], came[k] = reduced, j
                    if least[k] < delta:
                        delta, nxt = least[k], k
            for k in range(n + 1):
                if done[k]:
                    u[match[k]] += delta
                    v[k] -= delta
                elif k < n:
                    least[k] -= delta
            j = nxt
        while j != n:
            match[j], j = match[came[j]], came[j]
    found = [-1] * len(score)
    for k in range(n):
        if match[k] < len(score) and score and k < len(score[0]) and score[match[k]][k] > 0:
            found[match[k]] = k
    return found


def compare(old: dict[str, dict], new: dict[str, dict], same: float = SAME_VALUES) -> list[tuple[str, str, str]]:
    """Changes between two profiles ``path -> {kind, sketch, exact}``: (change_kind, old_path, new_path).

    Parents are settled before their fields, so that a field of a renamed parent
    is compared with its counterpart and fields below a change aren't reported
    on its account.
    """

    def children(profile: dict[str, dict]) -> dict[str, dict[str, str]]:
        by: dict[str, dict[str, str]] = defaultdict(dict)
        for path in sorted(profile, key=len):
            # a name may hold dots itself: the parent is the longest known prefix
            at = max((i for i, c in enumerate(path) if c == "." and (path[:i].removesuffix("[]") in profile)), default=-1)
            by[path[:at] if at >= 0 else ""][path[at + 1 :]] = path
        return by

    kids_old, kids_new, changes = children(old), children(new), []
    todo = [("", "")]
    while todo:
        a, b = todo.pop()
        ka, kb = kids_old.get(a, {}), kids_new.get(b, {})
        kept = []
        for name in ka.keys() & kb.keys():
            if old[ka[name]]["kind"] == new[kb[name]]["kind"]:
                kept.append((ka[name], kb[name]))
            else:
                changes.append(("retyped", ka[name], kb[name]))
        gone, come = sorted(ka.keys() - kb.keys()), sorted(kb.keys() - ka.keys())

        def score(x: str, y: str) -> float:
            p, q = old[ka[x]], new[kb[y]]  # noqa: B023
            if p["kind"] != q["kind"]:
                return 0.0
            if not p["sketch"] and not q["sketch"]:  # no record of it in both files: only a respelt name counts
                return 0.5 if plain_name(x) == plain_name(y) else 0.0
            leaf = not any(kids.get(path) or kids.get(path + "[]") for kids, path in ((kids_old, ka[x]), (kids_new, kb[y])))  # noqa: B023
            if leaf and p.get("exact") != q.get("exact"):
                return 0.0
            s = similarity(p["sketch"], q["sketch"])
            return s + 0.01 * name_likeness(x, y) if s >= same else 0.0

        pairs = assign([[score(x, y) for y in come] for x in gone]) if gone and come else []
        renamed = {gone[i]: come[j] for i, j in enumerate(pairs) if j >= 0}
        for x, y in renamed.items():
            changes.append(("renamed", ka[x], kb[y]))
            kept.append((ka[x], kb[y]))
        changes += [("removed", ka[x], "") for x in gone if x not in renamed]
        changes += [("added", "", kb[y]) for y in come if y not in renamed.values()]
        for p, q in kept:
            todo += [(p + "[]", q + "[]")] if old[p]["kind"] == "array" else [(p, q)] if old[p]["kind"] == "object" else []
    return changes


def _compare_group(frame: pd.DataFrame) -> pd.DataFrame:
    sides: tuple[dict, dict] = ({}, {})
    feed, file_no = frame.feed.iloc[0], int(frame.pair_file_no.iloc[0])
    for side, path, kind, n, regs in zip(frame.pair_side, frame.path, frame.kind, frame.n, frame.regs):
        have = sides[side].get(path)
        if have is None or (n, kind) > (have["n"], have["kind"]):
            # the older file's registers towards the next one, the later file's towards the previous one
            low = side * REGISTERS
            own = regs if regs is not None else ()
            exact = tuple(next((r["mins"] for r in own if r["reg"] == EXACT + side + more), None) for more in (0, 2))
            sides[side][path] = {"kind": kind, "n": n, "sketch": {r["reg"] - low: r["mins"] for r in own if low <= r["reg"] < low + REGISTERS}, "exact": exact}
    if not sides[0] or not sides[1]:
        return pd.DataFrame(columns=["feed", "file_no", "change_kind", "old_path", "new_path"])
    for s in sides:
        s.pop("", None)
    rows = [(feed, file_no, *c) for c in compare(*sides)]
    return pd.DataFrame(rows, columns=["feed", "file_no", "change_kind", "old_path", "new_path"])


def _record_key():
    return F.expr("try_variant_get(try_parse_json(payload), '$.record_key', 'string')")


def profile_files(lines: DataFrame) -> DataFrame:
    """What files hold: feed, file_no, path, kind, n records; staged."""
    rows = lines.mapInPandas(_fields, _FIELDS)
    return stage(rows.groupBy("feed", "file_no", "path", "kind").agg(F.sum("n").alias("n")), "profile")


def shared_records(lines: DataFrame) -> DataFrame:
    """feed, file_no, record_key, in_previous, in_next of the records that a file and a neighbour of it both hold."""
    keys = lines.select("feed", "file_no", _record_key().alias("record_key")).filter("record_key is not null").distinct()
    files = keys.select("feed", "file_no").distinct()
    w = Window.partitionBy("feed").orderBy("file_no")
    files = files.select("feed", "file_no", F.lead("file_no").over(w).alias("next_no"))
    # the few keys given again in the feed's next file
    again = keys.join(files.filter("next_no is not null"), ["feed", "file_no"]).select("feed", "record_key", "file_no", "next_no")
    later = keys.select("feed", "record_key", F.col("file_no").alias("next_no"))
    both = again.join(later, ["feed", "record_key", "next_no"])
    sides = both.select("feed", "record_key", "file_no", F.lit(False).alias("p"), F.lit(True).alias("x")).union(
        both.select("feed", "record_key", "next_no", F.lit(True), F.lit(False))
    )
    return sides.groupBy("feed", "record_key", "file_no").agg(F.max("p").alias("in_previous"), F.max("x").alias("in_next"))


def schema_changes(lines: DataFrame) -> DataFrame:
    """Every change between a file and the feed's preceding file.

    lines: feed, file_no, payload (one JSON object a row).  Lines without feed,
    number or readable object are passed over, and a file of which no line can
    be read is no file.  Null values don't count as presence; a field with
    several types has the one of most records (of equal counts the later name in
    the alphabet).  Repeated lines change nothing.  An empty table has no
    changes; other columns are ignored.
    """
    lines = lines.select("feed", F.col("file_no").cast("int"), "payload").filter("feed is not null and file_no is not null and payload is not null")
    fields = profile_files(lines)
    files = fields.filter("path = ''").select("feed", "file_no").distinct()
    w = Window.partitionBy("feed").orderBy("file_no")
    files = files.select("feed", "file_no", F.lead("file_no").over(w).alias("next_no"), F.when(F.lag("file_no").over(w).isNotNull(), F.col("file_no")).alias("own_no"))
    sided = (
        fields.join(files, ["feed", "file_no"])
        .withColumn("as", F.explode(F.array(F.struct(F.col("next_no").alias("pair_file_no"), F.lit(0).alias("pair_side")), F.struct(F.col("own_no").alias("pair_file_no"), F.lit(1).alias("pair_side")))))
        .select("feed", "file_no", "path", "kind", "n", "as.*")
        .filter("pair_file_no is not null")
    )
    # a path that both files of a pair have keeps its name; only the others' values are compared
    both = Window.partitionBy("feed", "pair_file_no", "path")
    sided = stage(sided.withColumn("alone", F.min("pair_side").over(both) == F.max("pair_side").over(both)), "fields")
    # by file the fields to sketch, and the lines of records that a neighbour holds too
    asked = sided.filter("alone").groupBy("feed", "file_no").agg(F.collect_set("path").alias("paths"))
    marked = lines.join(asked, ["feed", "file_no"]).withColumn("record_key", _record_key()).join(shared_records(lines), ["feed", "record_key", "file_no"])
    wanted = stage(marked.select("feed", "file_no", "payload", "in_previous", "in_next", "paths").mapInPandas(_sketches, _SKETCHES), "sketches")
    least = wanted.filter(F.col("reg") < EXACT).groupBy("of", "reg").agg(F.min("mins").alias("mins"))
    sums = wanted.filter(F.col("reg") >= EXACT).distinct().groupBy("of", "reg").agg(F.bit_xor("mins").alias("x"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("of", F.inline(F.array(F.struct("reg", F.col("x").alias("mins")), F.struct((F.col("reg") + 2).alias("reg"), F.col("n").alias("mins")))))
    sketches = least.unionByName(sums).groupBy("of").agg(F.collect_list(F.struct("reg", "mins")).alias("regs"))
    named = F.udf(_field_id, "bigint")  # of schemas, not of rows
    compared = sided.filter("alone").withColumn("of", named("feed", "file_no", "path", "kind")).join(sketches, "of", "left")
    plain = sided.filter("not alone").withColumn("regs", F.lit(None).cast("array<struct<reg:int,mins:bigint>>"))
    cols = ["feed", "pair_file_no", "pair_side", "path", "kind", "n", "regs"]
    return compared.select(cols).unionByName(plain.select(cols)).groupBy("feed", "pair_file_no").applyInPandas(_compare_group, CHANGE_SCHEMA)


#: The constant columns of the unified table, by plain field name.
UNIFIED_FIELDS = (
    "schema_version", "generated_at", "claims_notice", "sections", "claims", "evidence_spans", "metadata",
    "patient_information", "medical_summary", "billing_highlights", "legal_notes", "diagnoses_list", "providers_list", "medications_list",
)
UNIFIED_SCHEMA = "feed string, file_no int, line_id bigint, record_key string, " + ", ".join(f"{f} string" for f in UNIFIED_FIELDS) + ", extra map<string,string>"


def _lineage(frame: pd.DataFrame) -> pd.DataFrame:
    """Per file, the first names of the fields that had been renamed up to there."""
    rows, current = [], {}
    feed = frame.feed.iloc[0]
    changes = defaultdict(list)
    for file_no, kind, old, new in zip(frame.file_no, frame.change_kind, frame.old_path, frame.new_path):
        changes[file_no].append((kind, old, new))
    for file_no in sorted(changes):
        now = dict(current)
        for kind, old, new in sorted(changes[file_no]):
            if kind == "renamed":
                now.pop(old, None)
                leaf = current.get(old, old.rpartition(".")[2])
                now[new] = leaf
                for p, first in current.items():  # fields below a renamed parent keep their first names under its new path
                    for sep in (".", "[]."):
                        if p.startswith(old + sep):
                            now.pop(p, None)
                            now[new + p[len(old) :]] = first
            elif kind == "removed":
                now.pop(old, None)
        current = now
        rows.append((feed, file_no, list(current.items())))
    return pd.DataFrame({"feed": [r[0] for r in rows], "file_no": [r[1] for r in rows], "names": [dict(r[2]) for r in rows]})


def _restore(value: object, path: str, names: dict[str, str]) -> object:
    if isinstance(value, dict):
        return {names.get(p := f"{path}.{k}" if path else k, k): _restore(v, p, names) for k, v in value.items()}
    if isinstance(value, list):
        return [_restore(v, path + "[]", names) for v in value]
    return value


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)


def _unify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for feed, file_no, line_id, payload, names in zip(batch.feed, batch.file_no, batch.line_id, batch.payload, batch.names):
            record = read_object(payload)
            if record is None:
                continue
            record = _restore(record, "", dict(names) if names is not None else {})
            key, fields, extra = record.pop("record_key", None), dict.fromkeys(UNIFIED_FIELDS), {}
            for name, value in record.items():
                text, plain = _text(value), plain_name(name)
                if text is None:
                    continue
                if plain in fields and fields[plain] is None:
                    # a list or label object that took the place of a text gives its text
                    inner = value[0] if isinstance(value, list) and len(value) == 1 else value.get("label") if isinstance(value, dict) and set(value) <= {"label", "lang"} else None
                    fields[plain] = inner if isinstance(inner, str) else text
                else:
                    extra[name] = text
            rows.append((feed, file_no, line_id, None if key is None else str(key), *fields.values(), extra))
        yield pd.DataFrame(rows, columns=["feed", "file_no", "line_id", "record_key", *UNIFIED_FIELDS, "extra"])


def unify_records(lines: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """All readable records in one table of constant columns (:data:`UNIFIED_FIELDS`).

    Renamed fields come out under their first name, also inside nested values;
    scalars as text, nested values as JSON with sorted keys, and fields outside
    the constant ones in ``extra``.  Lines that hold no JSON object are left
    out (:func:`unreadable_lines` has them).
    """
    changes = schema_changes(lines) if changes is None else changes
    files = lines.select("feed", F.col("file_no").cast("int")).filter("feed is not null and file_no is not null").distinct()
    marks = files.select("feed", "file_no", F.lit("file").alias("change_kind"), F.lit("").alias("old_path"), F.lit("").alias("new_path"))
    lineage = changes.unionByName(marks).groupBy("feed").applyInPandas(_lineage, "feed string, file_no int, names map<string,string>")
    rows = lines.select("feed", F.col("file_no").cast("int"), "line_id", "payload").join(lineage, ["feed", "file_no"], "left")
    return rows.mapInPandas(_unify, UNIFIED_SCHEMA)


def unreadable_lines(lines: DataFrame) -> DataFrame:
    """Lines whose payload is no JSON object."""
    return lines.filter(F.coalesce(F.expr("schema_of_variant(try_parse_json(payload)) not like 'OBJECT%'"), F.lit(True)))
