"""Secret scans with multipart linking, by DataFrame functions alone.

Base secrets (assignments, access ids, long hex) are always reported. Identifiers, endpoints and weak secrets (short
assigned values, short hex, long opaque tokens) mean little alone: they are reported only where complementary parts stand
within one scope, found by an interval join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.llm import workspace as ws

#: Fixed values of the base kinds: patterns, and the least lengths of the value or match.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the whole run; the same as matches of AKIA[A-Z0-9]+ with 20 characters or more
HEX = r"[0-9a-f]{24,}"  # as runs of [0-9a-f]+ with 24 or more
ASSIGN_LEAST = 6
#: Parts that are weak alone.
IDENT = r"""\b(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
ENDPOINT = r"""\b(?i:https?|ssh|ftp|postgres|mysql|redis|mongodb|amqp)://[^\s"'<>|]{4,}"""
OPAQUE = r"""(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,}={0,2}"""
SHORT_HEX = r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{16,23}(?![0-9A-Za-z])"
#: Kinds in their order; the first three are the base.
KINDS = ("assign", "access", "hex", "ident", "endpoint", "weak")
#: Matches in a stretch.
STRETCH = 128
#: Code points within which parts belong to one scope.
SCOPE = 200


def found(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0, holds: tuple[str, ...] = ()) -> Column:
    """Spans (start, kind, end, ok) in code points of the leftmost non-overlapping matches; ok: the group has ``least``.

    Spark has no function for positions, but the pieces between the matches have lengths. They are summed up in stretches of
    STRETCH matches, then over the stretches, as each sum copies the list it adds to. A match holds one of ``holds``: a text
    without them is not searched.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), values.alias("value"))
    kind_type = "struct<start:int,kind:int,end:int,ok:boolean>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind_type}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), (F.length(x["value"]) >= least).alias("ok"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span))).alias("out"))

    def stretches(steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / STRETCH).cast("int")), lambda i: F.aggregate(F.slice(steps, i * STRETCH + 1, F.lit(STRETCH)), begin, step))

    def bases(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(parts, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def moved(part: Column, base: Column) -> Column:
        return F.transform(part["out"], lambda s: F.struct((s["start"] + base).alias("start"), s["kind"].alias("kind"), (s["end"] + base).alias("end"), s["ok"].alias("ok")))

    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  value is computed once in f
    spans = once(steps, lambda st: once(stretches(st), lambda parts: F.flatten(F.zip_with(parts, bases(parts), moved))))
    there = text.rlike(pattern)
    for x in holds[:1]:
        any_ = text.contains(x)
        for y in holds[1:]:
            any_ |= text.contains(y)
        there = any_ & there
    return F.when(there, spans).otherwise(F.array().cast(f"array<{kind_type}>"))


def written(spans: Column) -> Column:
    """kind:start:end of (start, kind, end) in their order, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, base spans and candidate spans of each row; written once, the texts stay behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.sha2("t", 256).alias("digest"),
        found(F.col("t"), ASSIGN, 0, ASSIGN_LEAST, 2, (":", "=")).alias("assign"),
        found(F.col("t"), ACCESS, 1, holds=("AKIA",)).alias("access"),
        found(F.col("t"), HEX, 2).alias("hex"),
        found(F.col("t"), IDENT, 3, holds=(":", "=")).alias("ident"),
        found(F.col("t"), ENDPOINT, 4, holds=("://",)).alias("endpoint"),
        found(F.col("t"), OPAQUE, 5).alias("opaque"),
        found(F.col("t"), SHORT_HEX, 5).alias("short"),
    )
    base = F.concat(F.filter("assign", lambda s: s["ok"]), F.col("access"), F.col("hex"))
    weak = F.concat(F.transform(F.filter("assign", lambda s: ~s["ok"]), lambda s: F.struct(s["start"].alias("start"), F.lit(5).alias("kind"), s["end"].alias("end"), s["ok"].alias("ok"))), F.col("opaque"), F.col("short"))
    return ws.cut(raw.select("doc_id", "digest", bare(base).alias("base"), bare(weak).alias("weak"), bare(F.concat("ident", "endpoint")).alias("parts")), "secrets")


def linked(scanned: DataFrame) -> DataFrame:
    """digest, more: the weak and complementary spans of each text that are reported, by an interval join within SCOPE.

    Spans of a text are dealt by stretches of SCOPE code points, and a complementary part is sent to every stretch that its
    scope touches, so the join is by equal keys and no text's spans need to meet in one task.
    """
    one = scanned.where("size(weak) + size(parts) > 0").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("base", "weak", "parts")))
    span = ["s.start", "s.kind", "s.end"]
    secrets = one.select("digest", F.explode(F.concat("base", "weak")).alias("s")).select("digest", *span)
    # an access id is itself an identifier for the secrets near it
    parts = one.select("digest", F.explode(F.concat("parts", F.filter("base", lambda s: s["kind"] == 1))).alias("s")).select("digest", *span)
    stretch = lambda c: F.floor(c / SCOPE).cast("int")
    dealt = parts.withColumn("cell", F.explode(F.sequence(stretch(F.col("start") - SCOPE), stretch(F.col("end") + SCOPE))))
    cells = secrets.withColumn("cell", stretch(F.col("start")))
    p, s = dealt.alias("p"), cells.alias("s")
    near = (F.col("p.digest") == F.col("s.digest")) & (F.col("p.cell") == F.col("s.cell")) & F.col("s.start").between(F.col("p.start") - SCOPE, F.col("p.end") + SCOPE)
    near &= (F.col("s.end") <= F.col("p.start")) | (F.col("s.start") >= F.col("p.end"))
    weak = s.where("s.kind = 5").join(p, near, "left_semi").select("digest", "start", "kind", "end")
    known = p.where("p.kind > 1").join(s, near, "left_semi").select("digest", "start", "kind", "end").distinct()
    more = ws.cut(weak.unionByName(known), "linked")
    # a span inside a base one says nothing new: both are sent to the stretches that they touch
    touched = lambda df: df.withColumn("cell", F.explode(F.sequence(stretch(F.col("start")), stretch(F.col("end")))))
    base = touched(one.select("digest", F.explode("base").alias("s")).select("digest", *span)).alias("b")
    m = touched(more).alias("m")
    over = (F.col("m.digest") == F.col("b.digest")) & (F.col("m.cell") == F.col("b.cell")) & (F.col("m.start") < F.col("b.end")) & (F.col("m.end") > F.col("b.start"))
    inside = m.join(base, over, "left_semi").select("digest", "start", "kind", "end").distinct()
    return more.join(inside, ["digest", "start", "kind", "end"], "left_anti").groupBy("digest").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest, base (spans) and spans (base ones and those linked) of each row."""
    scanned = scan(docs)
    both = ws.salted_join(scanned.select("doc_id", "digest", "base"), linked(scanned), "digest", "doc_id", "left")
    return both.select("doc_id", "digest", "base", F.concat("base", F.coalesce("more", F.array().cast(both.schema["base"].dataType))).alias("spans"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of docs (doc_id, text).

    A null text is empty; without spans the strings are empty and the hash is that of the empty string. Equal texts give equal
    spans, in each of their rows. Positions are code points, ends exclusive.
    """
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return all_spans(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret span (base or weak) of the text replaced by the mark; n_chars, if there, set anew. No row goes."""
    every = ws.cut(all_spans(docs).select("digest", F.filter("spans", lambda s: ~s["kind"].isin(3, 4)).alias("__spans")), "spans")
    hit = every.where("size(__spans) > 0").groupBy(F.col("digest").alias("__digest")).agg(F.first("__spans").alias("__spans"))
    keyed = docs.withColumn("__digest", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).withColumn("__spread", ws.id_order())
    counts = every.groupBy(F.col("digest").alias("__digest")).count()
    keyed = ws.salted_join(keyed, hit, "__digest", "__spread", "left", counts).drop("__digest", "__spread")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]  # else it overlaps the span before: that one's mark stands for both
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    text = F.aggregate(F.array_sort("__spans"), begin, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    out = keyed.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text)).drop("__spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
