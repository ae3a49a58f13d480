"""Quality, toxicity and decontamination, and the pipeline that uses them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulseframe.llm import decontaminate, quality, simhash, toxicity
from tests.llm.test_near_copies import brute_force as similar_groups
from pulseframe.llm.common import shared_path

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def test_quality_is_learned_and_holds_on_held_out_rows(spark, tables):
    train = tables["labels"].where("doc_id % 4 <> 0")
    seen = quality.views(tables["documents"])
    model = quality.fit(tables["documents"], train, rounds=1)
    rows = quality.score(seen, model).join(tables["labels"].where("doc_id % 4 = 0"), "doc_id").collect()
    assert len(rows) > 80 and sum(r.keep == (r.quality == 1) for r in rows) >= 0.97 * len(rows)
    kept = quality.keep_good(tables["documents"], model)
    assert kept.columns == tables["documents"].columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in quality.score(seen, model).where("keep").collect()}


def test_quality_of_messy_rows(spark, messy, labels):
    model = quality.fit(messy, labels, rounds=1)
    assert quality.score(quality.views(messy), model).count() == messy.count()
    assert quality.keep_good(messy, model).columns == messy.columns
    for none in (labels.limit(0), labels.where("quality = 1")):
        model = quality.fit(messy, none)
        assert quality.keep_good(messy, model).count() == messy.count()
    assert quality.score(quality.views(messy.limit(0)), quality.fit(messy.limit(0), labels)).count() == 0


def test_toxicity_is_learned_and_holds_on_held_out_rows(spark, tables):
    model = toxicity.fit(tables["documents"], tables["labels"])
    rows = toxicity.score(tables["documents"], model).join(tables["labels"], "doc_id").where(toxicity.held_out()).where("toxic = 0").collect()
    assert sum(r.score < toxicity.THRESHOLD for r in rows) >= 0.98 * len(rows)
    english = tables["documents"].where("lang = 'en'")
    rows = toxicity.score(english, model).join(tables["labels"], "doc_id").where(toxicity.held_out()).where("toxic = 1").collect()
    assert sum(r.score >= toxicity.THRESHOLD for r in rows) >= 0.7 * len(rows)
    text = {r.doc_id: r.text for r in english.collect()}
    spans = [text[r.doc_id][s.begin:s.end] for r in rows for s in r.spans]
    assert spans and all(not any(c.isspace() for c in s) for s in spans)


def test_settled_runs_do_not_change_marginals():
    model = toxicity.ToxicModel()
    model.emit[:] = [-6, 1, 2, 3, 4, 1, 2, 3, 4]
    model.move[:] = [[1.0, -1.0], [-0.5, 0.5]]
    rng = random.Random(2)
    kinds = [0] * 400
    for i in rng.sample(range(400), 6):
        kinds[i] = rng.randint(1, 8)
    whole = model.chain(kinds)[0]
    for at, n, p in model.marginals(kinds):
        assert all(abs(whole[i] - p) < 1e-9 for i in range(at, at + n))
    assert sum(n for _, n, _ in model.marginals(kinds)) == 400


def test_marginals_are_those_of_all_taggings():
    model = toxicity.ToxicModel()
    model.emit[:] = [-1, 1, 2, 3, 4, 1, 2, 3, 4]
    model.move[:] = [[0.7, -0.2], [0.1, 0.4]]
    model.start = 0.3
    kinds, weight, toxic = [0, 3, 0, 1], 0.0, [0.0] * 4
    for tags in range(16):
        y = [tags >> i & 1 for i in range(4)]
        w = float(__import__("math").exp(sum(model.emit[k] * t for k, t in zip(kinds, y)) + model.start * y[0] + sum(model.move[a, b] for a, b in zip(y, y[1:]))))
        weight += w
        toxic = [s + w * t for s, t in zip(toxic, y)]
    assert model.chain(kinds)[0] == pytest.approx([t / weight for t in toxic])


def test_toxicity_of_messy_rows(spark, messy, labels):
    model = toxicity.fit(messy, labels)
    rows = toxicity.score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.keep_clean(messy, model).columns == messy.columns
    none = toxicity.fit(messy, labels.limit(0))
    assert {r.score for r in toxicity.score(messy, none).collect()} == {0.0}
    assert toxicity.score(messy.limit(0), toxicity.fit(messy.limit(0), labels)).count() == 0


ITEM = "If Maria Silva walks 12 km in 3 hours with her old grey dog, how many metres will Maria Silva walk in 45 minutes on the same road?"


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(docs)], "doc_id long, text string, item_id int, form string")
    b = spark.createDataFrame([(i, t, "y") for i, t in enumerate(items)], "item_id long, text string, k string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b, **options).collect()}


def test_templates_catch_other_values_and_leave_clean_text(spark):
    other = ITEM.replace("Maria Silva", "Ivan").replace("12 km", "7.5 miles").replace("45 minutes", "20 s")
    clash = ITEM.replace("will Maria Silva walk in 45", "will Juan walk in 3").replace("12", "3")
    docs = [ITEM, "x y. " + other + " and more", clash, None, "", "walks in with her old grey dog", "Some text. " * 2000 + ITEM.upper(), "Some words. " * 3000 + ITEM]
    found = leaks(spark, docs, [ITEM, None, "", "12 34", "word"])
    assert {k for k in found if k[1] == 0} == {(0, 0), (1, 0), (2, 0), (6, 0), (7, 0)}
    assert 0.6 <= found[2, 0].coverage < 1.0  # clashes cost their windows only
    assert found[0, 0].same_values and not found[1, 0].same_values
    assert found[0, 0].coverage == 1.0


def test_leaks_equal_brute_force(spark, tables):
    """The covered share of an item's tokens by consistent windows within a stretch, counted directly."""
    import regex
    docs, items = tables["documents"].collect(), tables["benchmark"].collect()
    token = regex.compile(f"{decontaminate.NAME_RUN}|{decontaminate.NUMERAL}|{decontaminate.WORD}")
    units = set(decontaminate.UNITS)

    def form(text):
        raw = token.findall(regex.sub(decontaminate.NAME_START, " " + decontaminate.NAME, text or ""))
        out = []
        for i, t in enumerate(raw):
            number = lambda s: regex.match(r"\p{N}", s) is not None
            out.append(decontaminate.NAME if t[0] == decontaminate.NAME else decontaminate.NUMBER if number(t)
                       else decontaminate.UNIT if i and number(raw[i - 1]) and t.lower() in units else t.lower())
        return out, [t.lower() for t in raw]

    slots = {decontaminate.NAME, decontaminate.NUMBER, decontaminate.UNIT}
    templates, values, sizes = {}, {}, {}
    for it in items:
        f, raw = form(it.text)
        sizes[it.item_id], width = len(f), min(5, len(f))
        for j in range(len(f) - width + 1 if f else 0):
            plain = sum(x not in slots for x in f[j:j + width])
            known, here = (values, raw) if plain < min(3, len(f)) or plain == 0 else (templates, f)
            known.setdefault(tuple(here[j:j + width]), []).append((it.item_id, j, tuple(raw[j:j + width])))
    widths = {min(5, n) for n in sizes.values() if n}
    expected = {}
    for d in docs:
        f, raw = form(d.text)
        found = {}
        for w in widths:
            for i in range(len(f) - w + 1):
                for item, j, known in (*templates.get(tuple(f[i:i + w]), ()), *values.get(tuple(raw[i:i + w]), ())):
                    found.setdefault((item, i - j), set()).add((i, j, w, tuple((s, a, b) for a, b, s in zip(known, raw[i:i + w], f[i:i + w]) if s in slots)))
        covered = {}
        for (item, _), rows in found.items():
            pairs = {v for *_, vs in rows for v in vs}
            here = Counter((s, a) for s, a, _ in pairs)
            known = Counter((s, b) for s, _, b in pairs if s == decontaminate.NAME)
            clash = {(s, a, b) for s, a, b in pairs if a != b and (here[s, a] > 1 or known[s, b] > 1)}
            # A clash costs every window laid the same way over the same tokens of the item.
            bad = {(j, w) for _, j, w, vs in rows if clash & set(vs)}
            for i, j, w, _ in rows:
                if (j, w) not in bad:
                    for stretch in range(i // sizes[item] - 2, i // sizes[item] + 1):
                        covered.setdefault((item, stretch), set()).update(range(j, j + w))
        for (item, _), c in covered.items():
            share = round(len(c) / sizes[item], 6)
            if len(c) / sizes[item] >= decontaminate.COVERAGE:
                expected[d.doc_id, item] = max(share, expected.get((d.doc_id, item), 0))
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.contaminated(tables["documents"], tables["benchmark"]).collect()}
    assert got == expected and len(got) > 10


def test_pieces_far_apart_are_no_copy(spark):
    words = ITEM.split()
    pieces = [" ".join(words[i:i + 5]) for i in range(0, len(words), 5)]
    rng = random.Random(2)
    rng.shuffle(pieces)
    apart = " ".join(p + " " + " ".join(rng.choice(["vo", "la", "ki", "mer", "dus"]) for _ in range(300)) for p in pieces)
    put_in = " ".join(w + (" indeed" if i in (8, 16) else "") for i, w in enumerate(words))
    assert {k[0] for k in leaks(spark, [apart, put_in, ITEM], [ITEM])} == {1, 2}


def test_very_long_names_and_numerals(spark):
    names, number = "Anna " * 100_000, "1" + ",1" * 100_000
    assert {k[0] for k in leaks(spark, [names, number, "say " + names + number, ITEM], [ITEM])} == {3}


def test_clean_keeps_rows_and_columns(spark, messy):
    items = spark.createDataFrame([(1, messy.where("doc_id = 6").first().text)], "item_id long, text string")
    left = decontaminate.clean(messy, items)
    assert left.columns == messy.columns and left.where("doc_id IN (6, 7, 8)").count() == 0
    assert left.count() == messy.where("doc_id IS NULL OR doc_id NOT IN (6, 7, 8)").count()
    assert decontaminate.clean(messy, items.limit(0)).count() == messy.count()
    assert decontaminate.clean(messy.limit(0), items).count() == 0


def test_stages_on_messy_documents(spark, messy, labels):
    folder = shared_path(spark, "t")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it in the documents at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (messy, messy.limit(0)):
            out = stage(spark, docs, folder)
            assert out.count() <= docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_pipeline_stage_by_stage(spark, tables):
    docs, ids = tables["documents"], lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        kept[name] = (ids(docs), ids(out))
        if out.columns == docs.columns:
            path = shared_path(spark, "t")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
    bad = ids(tables["labels"].where("quality = 0"))
    before, after = kept["quality classifier"]
    assert not bad & after and len((before - after) - bad) < 0.15 * len(before)
    texts = {r.doc_id: r.text for r in tables["documents"].collect() if r.doc_id in kept["near duplicates"][0]}
    assert kept["near duplicates"][1] == set(similar_groups(texts).values())
    leaks_found = {r.doc_id for r in decontaminate.contaminated(tables["documents"], tables["benchmark"]).collect()}
    before, after = kept["benchmark decontamination"]
    assert after == before - leaks_found
    assert kept["byte-pair encoding"][0] == kept["byte-pair encoding"][1]
