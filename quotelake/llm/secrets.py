"""Secret scans with corpus-wide ownership frequency.

Patterns find candidate credentials in every whole text. Each candidate's value, in one spelling, is hashed and counted over the corpus: in how many
repositories and by how many owners does it stand? A value that several owners have is a copied example; one that a single owner
(or fewer than ``example_owners``) has looks live. A live value found by a pattern is also reported where the same owner wrote it
without the words that give it away: those spans are of kind ``owned``.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelake.session import stage

#: The base patterns, their kinds in order, and the least length of what counts.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: What may be a value that stands alone: a long run of credential characters with letters and digits.
LOOSE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
LOOSE_VALUE = 12
OWNED = 3
EXAMPLE_OWNERS = 3

_SPAN = [("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("value", pa.binary())]
_SPANS = "array<struct<kind:int,start:long,end:long,value_start:long,value_end:long,value:binary>>"
_HIT = re.compile(r"[A-Za-z]")
_DIGIT = re.compile(r"[0-9]")


def _loose(value: str) -> bool:
    return len(value) >= LOOSE_VALUE and bool(_DIGIT.search(value) and _HIT.search(value))


def _core(value: str) -> str:
    """The value in the one spelling it is counted by: no '.' or '=' around it (padding, the end of a sentence), and of name=value
    the part after the last '=' where that could stand alone."""
    core = value.strip(".=")
    last = core.rpartition("=")[2]
    return last if _loose(last) else core or value


def _hash(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value start, value end) of the base patterns, by start, then kind. Positions are code points."""
    out = []
    if ":" in text or "=" in text:
        out += [(0, *m.span(), *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    if "AKIA" in text:
        out += [(1, *m.span(), *m.span()) for m in ACCESS.finditer(text)]
    out += [(2, *m.span(), *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str | None) -> list[dict]:
    """Base spans and, of kind ``owned``, loose values outside them that are yet to be judged."""
    if not text:
        return []
    spans = base_spans(text)
    taken = sorted((a, b) for _, a, b, _, _ in spans)
    k, reach = 0, -1
    for m in LOOSE.finditer(text):
        a, b = m.span()
        value = _core(m[0])
        if not _loose(value):
            continue
        a += m[0].rindex(value)
        b = a + len(value)
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= a:
            spans.append((OWNED, a, b, a, b))
    return [{"kind": s[0], "start": s[1], "end": s[2], "value_start": s[3], "value_end": s[4], "value": _hash(_core(text[s[3] : s[4]]))} for s in sorted(spans, key=lambda s: (s[1], s[0]))]


def _find(docs: DataFrame, carried: list[Column]) -> DataFrame:
    """uid (fixed once written), the carried columns in a struct ``row``, and ``spans``."""
    rows = docs.select(F.struct(*carried).alias("row"), F.col("text").cast("string").alias("text"))
    span_type = pa.list_(pa.struct(_SPAN))

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            spans = [candidates(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(range(uid, uid + n), pa.int64()), pa.array(spans, span_type)], schema=pa.schema([batch.schema.field("row"), ("uid", pa.int64()), ("spans", span_type)]))
            uid += n

    kind = rows.select("row").withColumn("uid", F.lit(0).cast("long")).withColumn("spans", F.lit(None).cast(_SPANS)).schema
    return rows.mapInArrow(run, kind)


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS, carry: list[str] | None = None) -> DataFrame:
    """Every document with its judged spans: ``row`` (the columns named in ``carry``, all by default) and ``spans``, an array of
    (kind, start, end, value_start, value_end, owners, repositories, live) by start, then kind.

    A null owner or repository counts as one of its own. A null or empty text has no spans; repeated rows are each answered, and count as
    one repository if their repository is the same. Base spans are all reported; ``owned`` ones only if the value is live and the
    same owner has it in a base span too. The counts are over all documents.
    """
    names = docs.columns if carry is None else carry
    who = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00none"))
    carried = [F.struct(*[F.col(f"`{c}`") for c in names]).alias("own"), who(repository).alias("repository"), who(owner).alias("owner")]
    found = stage(_find(docs, carried))
    spans = found.where(F.size("spans") > 0).select("uid", F.col("row.repository").alias("repository"), F.col("row.owner").alias("owner"), F.explode("spans").alias("s")).select("uid", "repository", "owner", "s.*")
    # one row per value, owner and repository first, so that a value all the corpus has costs each task little
    held = spans.groupBy("value", "owner", "repository").agg(F.min("kind").alias("kind"))
    by_owner = held.groupBy("value", "owner").agg(F.count("*").alias("pairs"), F.min("kind").alias("kind"))
    repos = held.select("value", "repository").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    stats = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.min("kind").alias("best")).where(F.col("best") < OWNED).join(repos, "value")
    # one row per known value and owner: whether this owner has it in a base span
    known = stage(by_owner.select("value", "owner", (F.col("kind") < OWNED).alias("holds")).join(stats, "value"))
    judged = spans.join(known, ["value", "owner"]).select(
        "uid", F.struct("kind", "start", "end", "value_start", "value_end", "owners", "repositories", (F.col("owners") < example_owners).alias("live")).alias("s"), "holds")
    judged = judged.where((F.col("s.kind") < OWNED) | (F.col("s.live") & F.col("holds")))
    by_doc = judged.groupBy("uid").agg(F.collect_list("s").alias("judged"))  # a document's own spans only
    with_spans = found.where(F.size("spans") > 0).join(by_doc, "uid", "left").select("row.own", F.col("judged").alias("spans"))
    empty = F.lit(None).cast(with_spans.schema["spans"].dataType)
    out = with_spans.unionByName(found.where(F.size("spans") == 0).select("row.own", empty.alias("spans")))
    ordered = F.array_sort(F.coalesce("spans", F.array().cast(with_spans.schema["spans"].dataType)), lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["kind"] - b["kind"]))
    return out.select(F.col("own").alias("row"), ordered.alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (text), n_live, n_example, n_owned."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in (*KINDS, "owned")]), s["kind"] + 1)
    show = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k  # noqa: E731  a second argument would be the position
    base = F.filter("spans", lambda s: s["kind"] < OWNED)
    return scanned.select(
        F.col("row.doc_id").alias("doc_id"),
        *[count(of_kind(k)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(show(base), 256).alias("base_sha256"),
        show(F.col("spans")).alias("spans"),
        count(lambda s: (s["kind"] < OWNED) & s["live"]).alias("n_live"),
        count(lambda s: (s["kind"] < OWNED) & ~s["live"]).alias("n_example"),
        count(lambda s: s["kind"] == OWNED).alias("n_owned"),
    )


MASK = "[secret]"


def redact(docs: DataFrame, repository: str = "doc_id", owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs with every live value replaced by ``[secret]``; copied examples and all other text stay. ``n_chars``, where there is one,
    follows the text. Documents without a live value come out as they were."""
    scanned = scan(docs, repository, owner, example_owners)
    has_count = "n_chars" in docs.columns
    live = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["value_start"].alias("a"), s["value_end"].alias("b")))
    rows = scanned.select("row.*", live.alias("__live"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, changed = batch.column(at).to_pylist(), {}
            for i, spans in enumerate(batch["__live"].to_pylist()):
                parts, end = [], 0
                for s in sorted(spans, key=lambda s: (s["a"], -s["b"])):
                    if s["a"] >= end:
                        parts += [texts[i][end : s["a"]], MASK]
                    end = max(end, s["b"])
                if spans:
                    changed[i] = "".join(parts) + texts[i][end:]
            columns = batch.drop_columns(["__live"])
            if changed:
                columns = columns.set_column(at, columns.schema.field(at), pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns.schema.field(at).type))
                if has_count:
                    n = columns.schema.get_field_index("n_chars")
                    columns = columns.set_column(n, columns.schema.field(n), pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(columns.column(n).to_pylist())], columns.schema.field(n).type))
            yield columns

    return rows.mapInArrow(run, docs.schema)
