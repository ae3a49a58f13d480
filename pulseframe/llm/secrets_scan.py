"""Secret scan that links the parts of a credential, with DataFrame functions only.

Strong spans stand alone: an assignment to a telling name, an access identifier of fixed form, a long
run of hexadecimal digits.  Weak candidates are account names, long mixed tokens and addresses of
services; each is reported only when the parts that complete it begin within the same scope, ``scope``
code points before or after it: an account name beside a secret, a mixed token beside an identifier, an address
beside both.

Places come from cutting the text at a pattern's matches and adding up lengths.  Candidates meet
the other parts by an interval join on stretches of the text as long as the scope: a stretch is one
row per role with its first and last place, so the join tells whether a part is in reach and
never forms pairs of parts, however many lie side by side.

Null texts are empty and give no span; rows with a null id are scanned too; repeated rows are scanned one by one.
Strong spans are never dropped, and weak ones may overlap them.  Columns other than the id and the
text take no part.  An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.llm.common import prepare, shared_path, stored, text_or_empty

SCOPE = 200
CHUNK = 512  # matches whose lengths are added up at once


def either_case(words: str) -> str:
    """A pattern's letters in either case, ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


NAMED = either_case("(password|passwd|secret|token|api_?key)")
ACCOUNT = either_case("(username|user|login|account|client_id|access_key_id)")
SET = r"""["']?\x20*[:=]\x20*["']?"""
# kind: role, pattern, what a match must be like.  The order is that of spans which begin at one place.
KINDS = {
    "assign": ("secret", rf"{NAMED}{SET}([A-Za-z0-9+/_.=-]+)", lambda m, p: F.length(F.regexp_extract(m, p, 2)) >= 6),
    "access": ("identifier", r"AKIA[A-Z0-9]+", lambda m, p: F.length(m) >= 20),
    "hex": ("secret", r"[0-9a-f]{24,}", None),
    "account": ("identifier", rf"{ACCOUNT}{SET}([A-Za-z0-9_.@-]+)", lambda m, p: F.length(F.regexp_extract(m, p, 2)) >= 3),
    "mixed": ("secret", r"[A-Za-z0-9+/]{32,}", lambda m, p: m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")),
    "address": ("endpoint", r"https?://[A-Za-z0-9._~:/?&=%-]{4,}", None),
}
ORDER = {kind: i for i, kind in enumerate(KINDS)}
BASE = ("assign", "access", "hex")
NEEDS = {"account": ("secret",), "mixed": ("identifier",), "address": ("identifier", "secret")}


def sums_before(lengths: Column) -> Column:
    """For each number the sum of those before it; in chunks, so that long arrays aren't copied once per number."""
    empty = F.array().cast("array<bigint>")
    add = lambda acc, v: F.struct((acc["sum"] + v).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
    zero = F.lit(0).cast("bigint")
    running = lambda values, start: F.aggregate(values, F.struct(start.alias("sum"), empty.alias("out")), add)["out"]
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")), lambda i: F.slice(lengths, i * CHUNK + 1, CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda acc, v: acc + v))
    return F.flatten(F.zip_with(chunks, running(totals, zero), running))


def with_spans(rows: DataFrame, kind: str, text: str = "text") -> DataFrame:
    """Adds the column ``kind``: ``array<struct<start, end>>`` in code points, end exclusive."""
    _, pattern, fits = KINDS[kind]
    spans = "array<struct<start:bigint,end:bigint>>"
    rows = rows.withColumn("_m", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size("_m")), F.length)
    rows = rows.withColumn("_m", F.when(F.size("_m") > 0, F.arrays_zip(F.col("_m").alias("m"), gaps.alias("gap"))))
    before = sums_before(F.transform("_m", lambda x: (x["gap"] + F.length(x["m"])).cast("bigint")))
    place = lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("m"))
    placed = F.zip_with("_m", before, place)
    if fits:
        placed = F.filter(placed, lambda x: fits(x["m"], pattern))
    found = F.transform(placed, lambda x: F.struct(x["start"], x["end"]))
    return rows.withColumn(kind, F.when(F.col("_m").isNotNull(), found.cast(spans)).otherwise(F.array().cast(spans))).drop("_m")


def linked_candidates(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``row, kind, start, end``: weak candidates whose complementary parts begin within ``scope``.

    ``found`` has ``row`` and one array of spans per kind.
    """
    weak = [k for k in KINDS if k not in BASE]
    some = found.where(" OR ".join(f"size(`{k}`) > 0" for k in weak))
    part = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), F.lit(KINDS[k][0]).alias("role"), x["start"].alias("start"), x["end"].alias("end"))
    each = F.concat(*[F.transform(k, part(k)) for k in KINDS])
    parts = some.select("row", F.inline(each)).withColumn("stretch", F.floor(F.col("start") / scope))
    stretches = parts.groupBy("row", "stretch", F.col("role").alias("other")).agg(F.min("start").alias("first"), F.max("start").alias("last"))
    candidates = parts.where(F.col("kind").isin(weak)).withColumn("stretch", F.explode(F.sequence(F.col("stretch") - 1, F.col("stretch") + 1)))
    reach = (F.col("last") >= F.col("start") - scope) & (F.col("first") <= F.col("start") + scope)
    met = (candidates.join(stretches, ["row", "stretch"]).where(reach & (F.col("role") != F.col("other")))
           .groupBy("row", "kind", "start", "end").agg(F.collect_set("other").alias("others")))
    enough = [(F.col("kind") == k) & F.size(F.array_except(F.array(*map(F.lit, roles)), "others")).isin(0) for k, roles in NEEDS.items()]
    return met.where(enough[0] | enough[1] | enough[2]).select("row", "kind", "start", "end")


def joined_spans(spans: Column) -> Column:
    """Spans ``array<struct<start, at, end>>`` as text, by start, then kind."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["at"]), x["start"], x["end"])))


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``key, assign, access, hex, linked``: each row's strong spans by kind and its linked candidates.

    Strong spans are ``array<struct<start, end>>``, candidates ``array<struct<start, at, end>>`` with the place of their kind.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text"))
    for kind in KINDS:
        rows = with_spans(rows, kind)
    # Written once: the numbers given to rows then stay the same, whatever is computed again.
    found = stored(rows.drop("text").withColumn("row", F.monotonically_increasing_id()), "secret-spans", f"{shared_path(spark, 'secrets')}/spans")
    at = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for k, i in ORDER.items()])
    linked = linked_candidates(found, scope).groupBy("row").agg(F.collect_list(F.struct("start", at.alias("at"), "end")).alias("linked"))
    none = F.array().cast("array<struct<start:bigint,at:int,end:bigint>>")
    return (found.join(linked, "row", "left")
            .select(F.col("id").alias(key), *BASE, F.coalesce("linked", none).alias("linked")))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the digest of the strong spans, and all spans as text."""
    placed = lambda k: lambda x: F.struct(x["start"].alias("start"), F.lit(ORDER[k]).alias("at"), x["end"].alias("end"))
    strong = F.concat(*[F.transform(k, placed(k)) for k in BASE])
    return found.select(key, *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined_spans(strong), 256).alias("base_sha256"),
                        joined_spans(F.concat(strong, "linked")).alias("spans"))


def _oracle() -> str:
    conditions = {"assign": "length(regexp_extract(x, pattern, 2)) >= 6", "access": "length(x) >= 20", "hex": "true",
                  "account": "length(regexp_extract(x, pattern, 2)) >= 3",
                  "mixed": "regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]')", "address": "true"}
    places = " UNION ALL ".join(f"""SELECT r, {at} AS place, '{kind}' AS kind, '{KINDS[kind][0]}' AS role, $p${KINDS[kind][1]}$p$ AS pattern,
  regexp_extract_all(t, $p${KINDS[kind][1]}$p$) AS m, string_split_regex(t, $p${KINDS[kind][1]}$p$) AS g FROM d""" for kind, at in ORDER.items())
    fits = " OR ".join(f"(kind = '{k}' AND {c})" for k, c in conditions.items())
    needs = " OR ".join(f"(w.kind = '{k}' AND " + " AND ".join(f"bool_or(o.role = '{r}')" for r in roles) + ")" for k, roles in NEEDS.items())
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({places}),
u AS (SELECT r, place, kind, role, pattern, unnest(m) AS x, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM m),
z AS (SELECT *, CAST(sum(length(gap) + length(x)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e FROM u),
f AS (SELECT r, place, kind, role, e - length(x) AS s, e FROM z WHERE {fits}),
k AS (SELECT w.r, w.place, w.kind, w.s, w.e FROM f w JOIN f o ON o.r = w.r AND o.s BETWEEN w.s - {SCOPE} AND w.s + {SCOPE}
  WHERE w.kind IN ({', '.join(f"'{x}'" for x in NEEDS)}) AND o.role <> w.role GROUP BY ALL HAVING {needs}),
b AS (SELECT r, {', '.join(f"count(*) FILTER (WHERE kind = '{x}') AS n_{x}" for x in BASE)}, {text} AS strong FROM f WHERE place < {len(BASE)} GROUP BY r),
a AS (SELECT r, {text} AS spans FROM (SELECT r, place, kind, s, e FROM f WHERE place < {len(BASE)} UNION ALL SELECT * FROM k) GROUP BY r)
SELECT doc_id, {', '.join(f"coalesce(n_{x}, 0) AS n_{x}" for x in BASE)}, sha256(coalesce(strong, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN a ON a.r = d.r
"""


ORACLE = _oracle()


def op12_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of strong spans, and all spans."""
    return digests(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))
