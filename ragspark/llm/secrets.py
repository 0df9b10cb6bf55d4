"""Secret scans with multipart credential linking, in DataFrame operations only.

Base spans, always reported, leftmost non-overlapping per kind: assign (a secret's name, a sign and a value of 6 or more
characters), access (AKIA and capitals or digits, 20 or more characters) and hex (24 or more hexadecimal digits).

Weak candidates are spans that mean nothing by themselves: ident (a named account, client or user identifier), opaque
(a lone token of 32 to 128 letters, digits, + and /, with capitals, small letters and digits) and endpoint (a URL with a host, or
a database or cloud host). A token that overlaps a base span or an ident is that span's own value, no part of its own, so
one value never completes itself. Parts are linked by an interval join: a candidate meets the parts that end within `reach`
code points before it or begin within that distance after it, so parts that overlap it don't count. The join's key is the
document and a bucket of that width; for each role a bucket holds the least and the greatest end and start of its parts,
which decide for all of them, so a candidate meets four rows however many parts a scope holds.
Reported are: ident, where a secret part (base or opaque) is in reach; opaque, where an identifier (access or ident)
is; endpoint, where both an identifier and a secret are.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned each; offsets are code points,
ends exclusive; equal starts are ordered by kind as listed in KINDS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.llm.shared import written

#: The base patterns. Names are in either case of any letter, so the long s and the Kelvin sign count.
ASSIGN = r"""(?iu:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Patterns of the weak candidates.
IDENT = r"""(?i:\b(?:account|client|user|tenant|access_?key)_?(?:id|name)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,128}={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"""\b(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|jdbc:[a-z]+)://[^\s"'<>]+|(?<![A-Za-z0-9_.-])[a-z0-9][a-z0-9.-]*\.(?:amazonaws\.com|windows\.net|googleapis\.com)\b"""
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
BASE = KINDS[:3]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "ident": "identifier", "opaque": "secret", "endpoint": "endpoint"}
REACH = 300
#: Matches that are walked in one run.
RUN = 256

SPANS = "array<struct<start:int,kind:int,end:int>>"


def spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """The matches as (start, kind, end). What lies between matches comes from split, with the same pattern and limit -1,
    so starts are running sums of the lengths of gaps and matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(found, F.length)
    rows = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), F.transform(values, F.length).alias("value"))
    empty = F.array().cast(SPANS)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["value"] >= least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def walk(rows: Column) -> Column:
        def steps(state: Column, first: Column) -> Column:
            """A run of matches by itself, so that appending copies the spans of the run, not all before it."""
            some = F.aggregate(F.slice(rows, first, RUN), F.struct(state["at"].alias("at"), empty.alias("out")), step)
            return F.transform(F.array(some), lambda r: F.struct(r["at"].alias("at"), F.concat(state["out"], r["out"]).alias("out")))[0]

        return F.aggregate(F.sequence(F.lit(1), F.size(rows), F.lit(RUN)), F.struct(F.lit(0).alias("at"), empty.alias("out")), steps, lambda s: s["out"])

    walked = F.transform(F.array(rows), walk)[0]  # rows are made once, not in each run
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def apart(found: Column, others: Column) -> Column:
    """Those of the spans, which don't overlap each other, that overlap none of the others. Both are walked once, by their
    starts: a span is dropped if one of the others before it reaches into it, or if the next one begins within it."""
    mark = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(own).alias("own")))
    empty, none = F.array().cast(SPANS), F.lit(None).cast("struct<start:int,kind:int,end:int>")

    def add(state: Column, x: Column) -> Column:
        waiting = state["waiting"]
        given = x["own"] & waiting.isNotNull()  # no other can begin within it any more
        span = F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
        kept = F.when(x["own"], F.when(x["start"] >= state["reach"], span).otherwise(none)).otherwise(F.when(x["start"] >= waiting["end"], waiting).otherwise(none))
        reach = F.when(x["own"], state["reach"]).otherwise(F.greatest(state["reach"], x["end"]))
        return F.struct(reach.alias("reach"), kept.alias("waiting"), F.when(given, F.concat(state["out"], F.array(waiting))).otherwise(state["out"]).alias("out"))

    def walk(rows: Column) -> Column:
        def steps(state: Column, first: Column) -> Column:
            some = F.aggregate(F.slice(rows, first, RUN), F.struct(state["reach"].alias("reach"), state["waiting"].alias("waiting"), empty.alias("out")), add)
            return F.transform(F.array(some), lambda r: F.struct(r["reach"].alias("reach"), r["waiting"].alias("waiting"), F.concat(state["out"], r["out"]).alias("out")))[0]

        start = F.struct(F.lit(0).alias("reach"), none.alias("waiting"), empty.alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(rows), F.lit(RUN)), start, steps, lambda s: F.when(s["waiting"].isNotNull(), F.concat(s["out"], F.array(s["waiting"]))).otherwise(s["out"]))

    every = F.array_sort(F.concat(mark(found, True), mark(others, False)))
    return F.when(F.size(found) == 0, found).otherwise(F.transform(F.array(every), walk)[0])


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(key, base, spans) for each row of docs: arrays of (start, kind, end), kind by its place in KINDS, sorted."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(spans(whole, ASSIGN, 0, ASSIGN_LEAST, 2), spans(whole, ACCESS, 1), spans(whole, HEX, 2))
    firm = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), whole.alias("text"), base.alias("base"), spans(whole, IDENT, 3).alias("ident"))
    opaque, endpoint = spans(F.col("text"), OPAQUE, 4), spans(F.col("text"), ENDPOINT, 5)
    rows = firm.select("row", "key", "base", "ident", opaque.alias("opaque"), endpoint.alias("endpoint"))
    rows = rows.select("row", "key", "base", F.concat("ident", apart(F.col("opaque"), F.concat("base", "ident")), "endpoint").alias("weak"))
    rows = written(rows, "spans")
    of = rows.filter(F.size("weak") > 0)
    roles = F.array(*(F.lit(ROLE[k]) for k in KINDS))
    part = of.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s", F.element_at(roles, F.col("s.kind") + 1).alias("role")).filter("role <> 'endpoint'")
    sides = F.explode(F.array(F.struct(F.lit("end").alias("side"), F.col("s.end").alias("at")), F.struct(F.lit("start").alias("side"), F.col("s.start").alias("at"))))
    part = part.select("row", "role", sides.alias("p")).select("row", "role", "p.*", F.floor(F.col("p.at") / reach).alias("bucket"))
    buckets = part.groupBy("row", "side", "bucket").agg(*(f(F.when(F.col("role") == role, F.col("at"))).alias(f"{name}_{role}") for role in ("identifier", "secret") for name, f in (("first", F.min), ("last", F.max))))
    asked = of.select("row", F.explode("weak").alias("s"))
    low, high = F.floor(F.col("s.start") / reach), F.floor(F.col("s.end") / reach)
    # what ends in the bucket of the start, or begins in that of the end, is near enough; what does so one bucket on stands on the right side
    near = F.array(*(F.struct(F.lit(side).alias("side"), bucket.alias("bucket"), F.lit(inner).alias("inner")) for side, bucket, inner in (("end", low, True), ("end", low - 1, False), ("start", high, True), ("start", high + 1, False))))
    met = asked.select("row", "s", F.explode(near).alias("n")).select("row", "s", "n.*").join(buckets, ["row", "side", "bucket"])

    def reached(role: str) -> Column:
        """Some part of this role ends within reach before the candidate, or begins within reach after it."""
        first, last, inner = F.col(f"first_{role}"), F.col(f"last_{role}"), F.col("inner")
        before = F.when(inner, first <= F.col("s.start")).otherwise(last > F.col("s.start") - reach)
        after = F.when(inner, last >= F.col("s.end")).otherwise(first < F.col("s.end") + reach)
        return F.coalesce(F.max(F.when(F.col("side") == "end", before).otherwise(after)), F.lit(False))

    linked = met.groupBy("row", "s").agg(reached("identifier").alias("identifier"), reached("secret").alias("secret"))
    kind = F.col("s.kind")
    wanted = ((kind == 3) & F.col("secret")) | ((kind == 4) & F.col("identifier")) | ((kind == 5) & F.col("identifier") & F.col("secret"))
    added = linked.filter(wanted).groupBy("row").agg(F.collect_list("s").alias("added"))
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPANS))))
    return rows.join(added, "row", "left").select(F.col("key").alias(key), F.array_sort("base").alias("base"), every.alias("spans"))
