"""Benchmark decontamination on templates, with DataFrame functions only.

A text becomes tokens: names (runs of capitalised words inside a sentence), numbers, words and
signs of units.  Numbers, names and units (a unit word or sign after a number) become typed
placeholders, other words are lower-cased.  Every window of ``window`` template tokens of every
document is hashed and joined with the hashed windows of the benchmark items; equal hashes are
confirmed token by token.

Slots are then compared: within one alignment of document and item each benchmark value must
stand for one document value and the other way round, so that a question asked again with
other numbers or names is caught, and a chance match of placeholders is not.  Only documents that
matched a window with slots are looked at again for their values.  The share of the item's
tokens covered by consistent windows decides, counted within one stretch of the document three times as long as
the item: pieces of an item scattered over a long text don't add up.

A clash costs only the windows that hold it: changed values of an item value that stands for several, and changed
names that stand for several item names; values equal to the item's never clash, and numbers and units may coincide.
Windows with too few plain words are indexed too, by their values as they stand, so that an item's own text covers all of it.

Null and empty texts match nothing, nor do rows with a null id.  Repeated documents and items
are matched one by one, by id.  An item shorter than a window is one window of all its tokens; an item without a token
matches nothing.  Empty tables give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.llm.common import prepare, stored, text_or_empty

WINDOW, LITERALS, COVERAGE = 5, 3, 0.6
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"  # placeholders; also the mark before a name
# A capitalised word that a letter, a digit, a comma or a semicolon precedes in the same sentence.
NAME_START = r" (?<=[\p{L}\p{N},;] )(?=\p{Lu}\p{Ll})"
# Possessive repeats: the others recurse once per word, which a long run of names would not survive.
NAME_RUN = rf"{NAME}\p{{Lu}}[\p{{L}}\p{{M}}]*+(?: {NAME}?\p{{Lu}}[\p{{L}}\p{{M}}]*+)*+"
NUMERAL = r"\p{N}++(?:[.,:/]\p{N}++)*+"
WORD = r"[\p{L}\p{M}]+|[%°$€£]"
# Unit words and signs.
UNITS = ("mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres "
         "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
         "percent dollar dollars cent cents euro euros pound pounds degree degrees hz khz mhz ghz w kw v a n j kj mj pa kpa "
         "mph kmh b kb mb gb tb % ° $ € £").split()
# Benchmarks up to this many windows are sent to every executor; larger ones are joined by shuffle.
SMALL_BENCHMARK = 500_000


def marked(text: Column) -> Column:
    """The text with a mark before each name; marks of its own are blanked."""
    return F.regexp_replace(F.translate(text, NAME + NUMBER + UNIT, "   "), NAME_START, f" {NAME}")


def raw_tokens(text: Column) -> Column:
    """Tokens as they stand."""
    return F.regexp_extract_all(marked(text), F.lit(f"{NAME_RUN}|{NUMERAL}|{WORD}"), F.lit(0))


def template_tokens(text: Column) -> Column:
    """As many tokens as :func:`raw_tokens`, with placeholders for names and numbers; units come later."""
    t = F.regexp_replace(F.regexp_replace(marked(text), NAME_RUN, NAME), NUMERAL, NUMBER)
    return F.regexp_extract_all(F.lower(t), F.lit(f"[{NAME}{NUMBER}]|{WORD}"), F.lit(0))


def windows(df: DataFrame, keep: list[str], size: int) -> DataFrame:
    """``*keep, p, w1..wN``: from each token (at ``p``, from 0) on the next ``size`` template tokens, null past the end.

    The token array is laid beside its own shifted copies, so a row holds a window and never the
    text.  The outer form keeps the optimizer from testing the array's size in the scan, which would
    cut the text a second time.
    """
    shifted = [F.concat(F.array(F.lit(None).cast("string")), "t"), *[F.slice("t", i + 1, F.greatest(F.size("t") - i, F.lit(0))) for i in range(size)]]
    laid = df.select(*keep, F.size("t").alias("n_tokens"), F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)]).alias("z"))
    rows = laid.select(*keep, "n_tokens", F.posexplode_outer("z").alias("p", "w")).where("p < n_tokens").select(
        *keep, "n_tokens", "p", *[F.col("w").getField(f"w{i}").alias(f"r{i}") for i in range(size + 1)])
    unit = lambda i: F.when((F.col(f"r{i - 1}") == NUMBER) & F.col(f"r{i}").isin(UNITS), F.lit(UNIT)).otherwise(F.col(f"r{i}"))
    return rows.select(*keep, "n_tokens", "p", *[unit(i).alias(f"w{i}") for i in range(1, size + 1)])


def window_hash(width: int) -> Column:
    """Hash of the first ``width`` tokens; null where the text ends before."""
    return F.when(F.col(f"w{width}").isNotNull(), F.xxhash64(F.lit(width), *[F.col(f"w{i}") for i in range(1, width + 1)]))


def is_slot(form: Column) -> Column:
    return form.isin(NAME, NUMBER, UNIT)


def benchmark_windows(items: DataFrame, window: int, literals: int) -> DataFrame:
    """``item_id, n_tokens, at, width, hash, form, raw, words, exact, has_slots``: the windows of every item that can be recognised.

    ``words`` are what a document window must equal: the template, or the values as they stand
    (``exact``) where plain words are too few.
    """
    t = (items.where("item_id IS NOT NULL").select("item_id", text_or_empty().alias("text"))
         .select("item_id", template_tokens(F.col("text")).alias("t"), raw_tokens(F.col("text")).alias("whole")))
    w = windows(t, ["item_id", "whole"], window)
    wide = w.withColumn("width", F.least(F.lit(window), F.col("n_tokens"))).where(F.col("p") + F.col("width") <= F.col("n_tokens"))
    form = F.slice(F.array(*[F.col(f"w{i}") for i in range(1, window + 1)]), F.lit(1), F.col("width"))
    chosen = F.coalesce(*[F.when(F.col("width") == i, window_hash(i)) for i in range(1, window + 1)])
    out = wide.select("item_id", "n_tokens", F.col("p").alias("at"), "width", chosen.alias("hash"), form.alias("form"),
                      F.slice("whole", F.col("p") + 1, F.col("width")).alias("raw"))
    plain = F.size(F.filter("form", lambda f: ~is_slot(f)))
    out = out.withColumns({"exact": (plain < F.least(F.lit(literals), F.col("n_tokens"))) | (plain == 0), "has_slots": F.exists("form", is_slot)})
    out = out.withColumn("words", F.when(F.col("exact"), F.transform("raw", F.lower)).otherwise(F.col("form")))
    as_it_stands = F.coalesce(*[F.when(F.col("width") == i, F.xxhash64(F.lit(i), *[F.get("words", F.lit(j)) for j in range(i)])) for i in range(1, window + 1)])
    return out.withColumn("hash", F.when(F.col("exact"), as_it_stands).otherwise(F.col("hash")))


def matches(docs: DataFrame, known: DataFrame, *, window: int = WINDOW, key: str = "doc_id", exact: bool = False) -> DataFrame:
    """``key, p, item_id, n_tokens, at, width, has_slots, form, raw``: document windows equal to benchmark windows, all ``exact`` or none."""
    small = known.count() <= SMALL_BENCHMARK
    widths = sorted(r.width for r in known.select("width").distinct().collect())  # at most ``window`` values
    bench = known.select(*[F.col(c).alias(f"b_{c}") for c in known.columns])
    tokens = (lambda text: F.transform(raw_tokens(text), F.lower)) if exact else template_tokens
    t = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), tokens(text_or_empty()).alias("t"))
    w = windows(t, ["k"], window).drop("n_tokens")
    if widths in ([], [window]):
        rows = w.withColumn("width", F.lit(window)).withColumn("hash", window_hash(window))
    else:
        each = F.array(*[F.struct(F.lit(i).alias("width"), window_hash(i).alias("hash")) for i in widths])
        rows = w.withColumn("h", F.explode(each)).select("*", "h.width", "h.hash").drop("h")
    same = (F.col("hash") == F.col("b_hash")) & (F.col("width") == F.col("b_width"))
    for i in range(1, window + 1):  # the hash only finds candidates
        same = same & ((F.col("b_width") < i) | (F.col(f"w{i}") == F.get("b_words", F.lit(i - 1))))
    joined = rows.where("hash IS NOT NULL").join(F.broadcast(bench) if small else bench, same)
    return joined.select(F.col("k").alias(key), "p", *[F.col(f"b_{c}").alias(c) for c in ("item_id", "n_tokens", "at", "width", "has_slots", "form", "raw")])


def without_clashes(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Matched windows whose slots don't clash, with ``along, slots, same`` of their alignment."""
    by = [key, "item_id", "along"]
    text = (docs.join(found.where("has_slots").select(key).distinct(), key, "left_semi").select(key, raw_tokens(text_or_empty()).alias("t"))
            .select(key, F.posexplode("t").alias("place", "here")))
    slots = (found.where("has_slots").select(key, "item_id", "p", "at", "width", (F.col("p") - F.col("at")).alias("along"),
                                             F.posexplode(F.arrays_zip("form", F.col("raw").alias("known"))).alias("i", "s"))
             .select(*by, "p", "at", "width", (F.col("p") + F.col("i")).alias("place"), F.col("s.form").alias("form"), F.lower("s.known").alias("known"))
             .where(is_slot(F.col("form"))).join(text, [key, "place"]).withColumn("here", F.lower("here")))
    slots = stored(slots, "benchmark-slots")
    pairs = slots.select(*by, "form", "known", "here").distinct()
    several = pairs.groupBy(*by, "form", "known").agg(F.count("*").alias("n_here"))
    shared = pairs.where(F.col("form") == NAME).groupBy(*by, "form", "here").agg(F.count("*").alias("n_known"))
    clash = (pairs.where("known <> here").join(several, [*by, "form", "known"]).join(shared, [*by, "form", "here"], "left")
             .where("n_here > 1 OR n_known > 1").select(*by, "form", "known", "here"))
    bad = slots.join(clash, [*by, "form", "known", "here"], "left_semi").select(*by, "at", "width").distinct()
    values = pairs.groupBy(*by).agg(F.count("*").alias("slots"), F.bool_and(F.col("known") == F.col("here")).alias("same"))
    return (found.withColumn("along", F.col("p") - F.col("at")).join(bad, [*by, "at", "width"], "left_anti").join(values, by, "left")
            .withColumns({"slots": F.coalesce("slots", F.lit(0).cast("long")), "same": F.coalesce("same", F.lit(True))}))


def contaminated(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, literals: int = LITERALS,
                 coverage: float = COVERAGE, key: str = "doc_id") -> DataFrame:
    """``key, item_id, coverage, n_windows, n_slots, same_values``: documents that hold a benchmark item.

    ``coverage`` is the share of the item's tokens in consistent windows; ``same_values`` is false
    where the item was found with other numbers, names or units.
    """
    prepare(docs.sparkSession)
    known = stored(benchmark_windows(items, window, literals), "benchmark-windows")
    found = matches(docs, known.where("NOT exact"), window=window, key=key)
    if not (poor := known.where("exact")).isEmpty():
        found = found.unionByName(matches(docs, poor, window=window, key=key, exact=True))
    found = stored(found.distinct(), "benchmark-matches")
    if known.where("has_slots").isEmpty():
        kept = found.withColumns({"slots": F.lit(0).cast("long"), "same": F.lit(True)})
    else:
        kept = without_clashes(docs, found, key)
    # A stretch begins at every multiple of the item's length and is three lengths long: a copy with as much again put in between lies within one.
    stretch = F.floor(F.col("p") / F.col("n_tokens"))
    covered = (kept.withColumn("stretch", F.explode(F.sequence(stretch - 2, stretch)))
               .select(key, "item_id", "n_tokens", "stretch", "at", "slots", "same", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("width") - 1)).alias("token"))
               .groupBy(key, "item_id", "n_tokens", "stretch", "token")
               .agg(F.max(F.when(F.col("token") == F.col("at"), 1).otherwise(0)).alias("window"), F.max("slots").alias("slots"), F.bool_and("same").alias("same")))
    stretches = (covered.groupBy(key, "item_id", "n_tokens", "stretch")
                 .agg((F.count("*") / F.col("n_tokens")).alias("coverage"), F.sum("window").alias("n_windows"), F.max("slots").alias("n_slots"),
                      F.bool_and("same").alias("same_values"))
                 .where(F.col("coverage") >= coverage))
    best = F.max_by(F.struct("coverage", "n_windows", "n_slots", "same_values"), F.struct("coverage", "n_windows", "same_values", -F.col("stretch")))
    return (stretches.groupBy(key, "item_id").agg(best.alias("b"))
            .select(key, "item_id", F.round("b.coverage", 6).alias("coverage"), "b.n_windows", "b.n_slots", "b.same_values"))


def clean(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns kept; rows with a null key stay."""
    bad = contaminated(docs, items, key=key, **options).select(key).distinct()
    return docs.join(bad, key, "left_anti").select(*docs.columns)


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its coverage."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
