import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomaudit.llm import cutoff, digests, duplicates, garbling, leakage, packing, prose, residue, residue_grammar, wrappers

PAGE = "content_hash string, template_fp string, title string, normalized_url string"


# problem 2


def test_digest_errors_and_spans(spark):
    rng = random.Random(1)
    rows = [(i, "g" if i % 3 else None, "2024-01-%02d" % (1 + i % 4), int(rng.expovariate(0.001)) + 1, 7) for i in range(6000)]
    d = spark.createDataFrame(rows, "event_id long, site string, day string, load long, n long").withColumn("day", F.to_date("day"))
    twice = d.unionByName(d.filter("event_id % 10 = 0"))
    out = digests.percentiles_of(twice, ["site", "day"], ["load"], "event_id").collect()
    assert len(out) == 8 and sum(r["n"] for r in out) == 6000 and all(r["within_bound"] for r in out)
    exact = sorted(r[3] for r in rows if r[1] == "g" and r[2] == "2024-01-01")
    got = next(r for r in out if r["site"] == "g" and str(r["day"]) == "2024-01-01")
    assert abs(got["p50"] - exact[len(exact) // 2]) < 0.05 * exact[len(exact) // 2] + 5
    month = digests.spans_of(twice, ["site", "day"], ["load"], "event_id").collect()
    assert {r["n"] for r in month} == {2000, 4000} and all(r["within_bound"] for r in month)
    values = sorted(r[3] for r in rows if r[1])
    median = next(r["p50"] for r in month if r["site"] == "g")
    assert abs(sum(v < median for v in values) / len(values) - 0.5) < digests.bound(0.5)


def test_bounds_of_percentiles(spark):
    rng = random.Random(5)
    values = [int(rng.lognormvariate(5, 2)) + 1 for _ in range(20_000)]
    d = spark.createDataFrame([(i, "s", v) for i, v in enumerate(values)], "event_id long, site string, v long")
    out = digests.percentiles_of(d, ["site"], ["v"], "event_id").first()
    values.sort()
    assert out["within_bound"] and digests.bound(0.99) < digests.bound(0.5) / 4
    for p in digests.PERCENTILES:
        e = out[f"p{p * 100:g}"]
        below, upto = sum(v < e for v in values), sum(v <= e for v in values)
        assert below - 1 <= p * 20_000 + digests.bound(p) * 20_000 and upto >= p * 20_000 - digests.bound(p) * 20_000


def test_digest_parts_merge_as_one(spark, monkeypatch):
    monkeypatch.setattr(digests, "PART", 100)
    monkeypatch.setattr(digests, "FAN", 3)
    d = spark.range(3000).selectExpr("id as event_id", "'s' as site", "id * id as v")
    out = digests.percentiles_of(d, ["site"], ["v"], "event_id").first()
    assert out["n"] == 3000 and out["within_bound"]
    assert digests.percentiles_of(d.filter("false"), ["site"], ["v"], "event_id").count() == 0


# problem 6


def test_duplicates(spark):
    s = "row_id long, crawl_id string, title string, description string, first_row_id int"
    rows = [
        (5, "c", "The Pot!", "Colour: red; Weight: 2 g", 0), (3, "c", "the  pot", "weight: 2 g | COLOUR: red", 0), (9, "c", "THE POT", "colour red weight 2 g", 0),
        (4, "c", "the pot", "Colour: blue; Weight: 2 g", 0), (1, "d", "The Pot!", "Colour: red; Weight: 2 g", 0),
        (6, "c", None, "!!", 0), (7, "c", "", None, 0), (8, None, "the pot", "x", 0), (10, "c", "café", None, 0), (11, "c", "cafe", "", 0), (12, "c", "CAFÉ.", "", 0),
    ]
    got = {tuple(r) for r in duplicates.copies(spark.createDataFrame(rows, s)).collect()}
    assert got == {(3, 5), (3, 9), (10, 12)}
    reps = {(r["first_row_id"], r["copies"]) for r in duplicates.representatives(spark.createDataFrame(rows, s)).collect()}
    assert reps == {(3, 3), (10, 2)}
    assert duplicates.copies(spark.createDataFrame([], s)).count() == 0


def test_duplicates_of_two_readings(spark):
    s = "row_id long, crawl_id string, title string, description string"
    # one text read as fields in two ways joins the orders of both
    rows = [(1, "c", "t", "a: b; c: d e: f"), (2, "c", "t", "a: b; c: d; e: f"), (3, "c", "t", "e: f; c: d; a: b"), (4, "c", "t", "c: d e: f; a: b")]
    assert {tuple(r) for r in duplicates.copies(spark.createDataFrame(rows, s)).collect()} == {(1, 2), (1, 3), (1, 4)}


def test_field_parts():
    assert duplicates.field_parts("a: b; c: d") and duplicates.field_parts("a: b") is None
    assert duplicates.field_parts("a: b; c d") is None and duplicates.field_parts(": b; c: d") is None


# problem 7


@pytest.fixture(scope="module")
def restorer():
    words = "Küchenmesser Größe über für Öl Tür schöne Bücherregal Überraschung wählen hören café été déjà élève garçon où château".split()
    words += "Стол стола новый каталог показывает старую цену без причины раздел помощи главная страница Москва it’s don’t – — “good” naïve señor mañana não ação".split()
    return garbling.Restorer(garbling.fit([(w, 20) for w in words if garbling.is_clean(w)]))


@pytest.mark.parametrize("chain", ["utf-8 as cp1252", "utf-8 as latin-1", "utf-8 as cp1252, twice", "utf-8 as mac-roman", "utf-8 as cp850"])
def test_garbled_latin_comes_back(restorer, chain):
    clean = "Die größere Tür für das Bücherregal – schöne Überraschung"
    bad, fixed, chains, whole = restorer.text(garbling.garble(clean, chain))
    assert bad and whole and fixed == clean


@pytest.mark.parametrize("chain", ["cp1251 as cp1252", "koi8-r as cp1251", "utf-8 as cp1251"])
def test_garbled_cyrillic_comes_back(restorer, chain):
    clean = "новый каталог показывает старую цену без причины"
    assert restorer.text(garbling.garble(clean, chain))[:2] == (True, clean)


@pytest.mark.parametrize("clean", ["", "plain", "Die größere Tür", "новый каталог", "Þórður, ñandú, Łódź", "Shown as “â€™” for an apostrophe", "naïve café — 5 €"])
def test_clean_text_stays(restorer, clean):
    assert restorer.text(clean)[:2] == (False, clean)


def test_lost_text_is_found_but_not_whole(restorer):
    assert restorer.text("Sch�ne T�r") == (True, "Sch�ne T�r", "", False)


def test_every_chain_inverts_what_it_garbles():
    for chain in garbling.CHAINS:
        for w in ("Größe", "новый", "żółty"):
            g = garbling.garble(w, chain)
            assert g is None or garbling.invert(g, chain) == w


# problem 9


def test_leaks(spark):
    q = "Read the passage and answer. "
    p1 = "The kettle of Wexa was mended 15 times by the choir of Tibur before the shop opened again in Sarolund"
    p2 = "Auditors at Lund logged 89 addresses with redirect chains after Vik had moved 70 files to Torlund in spring"
    items = spark.createDataFrame([(1, q + p1, "15 times"), (2, q + p2, None), (3, None, "x"), (4, "", "")], "item_id long, text string, answer string")
    w = p1.split()
    swapped = " ".join("odd" if i in (3, 12) else x for i, x in enumerate(w))
    docs = [
        (1, "Before. " + p1.upper().replace(" ", "\n") + " after"), (2, swapped), (3, " ".join(w[:15])), (4, " ".join(w[:9])), (5, q + "Nothing else here"), (6, None), (7, ""),
        (8, p1 + " " + p2), (9, "Auditors at Nor logged 12 addresses with redirect chains after Sen had moved 33 files to Beck in spring"),
    ]
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (8, 1), (8, 2)}
    blocks = leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, block=1).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))
    assert {r["doc_id"] for r in got if r["answered"]} == {1, 2, 3, 8}
    first = next(r for r in got if r["doc_id"] == 1)
    assert docs[0][1][first["begins"] : first["ends"]].split() == p1.upper().split()


# problem 10


def test_cut_texts(spark):
    whole = [f"The crawl of Lund{chr(97 + i)} reached {i} pages and recorded cases of orphan pages. The shop owner should merge the redirects first." for i in range(20)]
    items = ["Findings.\n- orphan pages\n- redirect chains", "All is well.\n- redirect chains\n- orphan pages", "It ran twice.\nSent from the console", "It ran.\nSent from the console", "Then it ends. And so it goes...", "That was all. And so it goes..."]
    cut = ["The crawl of Lund reached 4 pages and recor", "The shop owner should merge the redirects first. The crawl of", "Findings.\n- orphan pages\n- redirect cha", "The shop owner should merge the…", "The shop owner [more]", "The shop owner should merge,"]
    texts = whole + items + cut + ["", None]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r["doc_id"] for r in cutoff.cut_texts(d).collect()}
    assert got == set(range(26, 32))
    rate = cutoff.cut_rates(d).first()
    assert (rate["texts"], rate["cut_texts"]) == (34, 6)


def test_key_filter_holds_every_key(spark):
    import numpy as np

    rng = random.Random(3)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(2000)]
    wanted = cutoff.key_filter(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert cutoff.passes(np.array(keys, np.int64), wanted).all()
    others = np.array([rng.randrange(-(2**63), 2**63) for _ in range(2000)], np.int64)
    assert cutoff.passes(others, wanted).mean() < 0.01
    assert not cutoff.passes(others, cutoff.key_filter(spark.createDataFrame([], "key long"))).any()


def test_long_sentences_and_last_lines_are_judged_whole(spark):
    long = "the " + " ".join(f"very{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))
    whole = [f"{long} crawl ended well. More." for _ in range(6)]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*whole, long + " crawl ended", long + " crawl en"])], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in cutoff.cut_texts(d).collect()} == {6, 7}


# problem 8


def test_packing(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["w"] * rng.randint(0, 60)) + f" d{i}", None if i % 5 else 3, f"s{i % 3}") for i in range(400)]
    docs = [(i, t, None, s) for i, t, _, s in docs] + [(1000 + i, "same text again", None, "s1") for i in range(30)] + [(2000, " ".join(["x"] * 250), None, None), (2001, None, None, "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_tokens int, source string")
    limits = spark.createDataFrame([("small", 64), ("large", 128)], "container_kind string, capacity_tokens int")
    out = packing.packed(d, limits, shard=200).toPandas()
    sizes = {i: len((t or "").split()) for i, t, _, _ in docs}
    for kind, capacity in (("small", 64), ("large", 128)):
        k = out[out.container_kind == kind]
        assert k.groupby("bin_id").tokens.sum().max() <= capacity
        assert k.groupby("doc_id").tokens.sum().to_dict() == sizes
        assert set(k[k.duplicated("doc_id", keep=False)].doc_id) == {2000}
        assert k[k.doc_id.between(1000, 1029)].groupby("bin_id").size().max() == 1
    fill = packing.fill(packing.packed(d.filter("doc_id < 400"), limits, shard=10_000)).toPandas()
    assert fill[fill.container_kind == "large"].unused_share.max() < 0.01 and fill.unused_share.max() < 0.05


def test_every_shard_has_a_task(spark):
    d = spark.range(6400).selectExpr("id as doc_id", "concat('text ', id) as text", "2 as n_tokens", "concat('s', id % 3) as source")
    limits = spark.createDataFrame([("k", 64)], "container_kind string, capacity_tokens int")
    for shards in (2, 8, 64):
        out = packing.packed(d, limits, shard=6400 // shards).withColumn("task", F.spark_partition_id())
        seen = out.select("task", F.split("bin_id", "-")[1].alias("shard")).distinct().collect()
        assert len(seen) == shards == len({r["task"] for r in seen}) == len({r["shard"] for r in seen})


def test_sources_as_a_limit(spark):
    rng = random.Random(4)
    items = sorted(((i, rng.randint(1, 30), i % 5, i) for i in range(3000)), key=lambda x: -x[1])
    made = list(packing.pack(iter(items), 100, per_source=2))
    held = {}
    for i, _, size, b in made:
        held.setdefault(b, []).append((i % 5, size))
    assert all(sum(s for _, s in x) <= 100 and max([k for k, _ in x].count(j) for j in range(5)) <= 2 for x in held.values())
    free = {m[3] for m in packing.pack(iter(items), 100)}
    assert len(free) <= -(-sum(x[1] for x in items) // 100) + 1


def test_many_bins_of_one_residual_stay_fast():
    import time

    items = [(i, 34, i % 3, i) for i in range(60_000)]
    began = time.time()
    assert len({m[3] for m in packing.pack(iter(items), 100, per_source=1)}) == 30_000
    assert time.time() - began < 10


def test_tokens_as_the_tokenizer_counts(spark):
    import re

    for t in ("It's 5 € – ok!", "a_b c d", "½ x² naïve", "", "日本 語。"):
        got = spark.createDataFrame([(t,)], "t string").select(packing.token_count(F.col("t")).alias("n")).first()["n"]
        assert got == len(re.findall(r"\w+|[^\w\s]+", t))


# problems 1, 3, 5


def site(n, body, lang="x"):
    out = []
    for i in range(n):
        lines = ["We use cookies to keep the shop running.", "Home | Shop | Help | Contact", f"Home > shop > {body(i)[0][:20]}", *body(i), "Share this: Mail | Print", "You may also like", f"Other piece {i + 50}", "Terms | Privacy | Site map", "Lund, 5 Mill Lane", "© 2025 Lund"]
        out.append((f"h{i}", "\n".join(lines)))
    return out


def prose_body(i):
    return [f"Copper kettle number {chr(97 + i % 26)}{i}", f"The kettle of the {chr(97 + i % 26)} guild is made of copper, and the choir mended it {i} times. Nobody expected it to last.", f"- It holds {i} cups of {chr(97 + i % 25)}{chr(97 + i % 23)} tea for the whole town", "Sizes" if i % 7 == 0 else f"Keep it dry in the {chr(97 + i % 24)} shed, because the wind turns there."]


def tables(spark, rows):
    content = spark.createDataFrame(rows, "hash string, content string")
    pages = spark.createDataFrame([(h, "t1", (t or "").split("\n")[3] if t and t.count("\n") > 3 else None, "https://lund.example/x") for h, t in rows], PAGE)
    return content, pages


def test_body_lines(spark):
    rows = site(30, prose_body)
    content, pages = tables(spark, [*rows, ("empty", ""), ("null", None)])
    got = {}
    for r in wrappers.body_lines(content, pages).collect():
        got.setdefault(r["hash"], set()).add(r["line_no"])
    assert got == {h: {4, 5, 6, 7} for h, _ in rows}
    assert wrappers.body_lines(content.filter("false"), pages).count() == 0
    assert wrappers.body_lines(content, pages.withColumn("template_fp", F.lit(None).cast("string"))).count() == 0


def test_body_lines_with_changing_digits(spark):
    consent = "This site shares usage data with {} partners of ours."
    rows = []
    for i in range(12):
        k, c = chr(97 + i), consent.format(31 + 7 * i)
        body = [f"Copper kettle {k}{k}", f"The kettle of the {k} guild is made of copper, and the {k}{k} choir mended it.", f"Width | {10 + i % 9} cm", f"Weight | {200 + i} g", c if i % 2 else f"Nobody in {k} town expected it to last.", f"{100 + i} crowns"]
        rows.append((f"h{i}", "\n".join([c, "Home | Shop | Help | Contact", "Skip to the goods", *body, "You may also like", f"Other piece {i + 50}", "Terms | Privacy | Site map", f"Copyright 2025 Lund | build {300 + i}"])))
    content, pages = tables(spark, rows)
    got = {}
    for r in wrappers.body_lines(content, pages).collect():
        got.setdefault(r["hash"], set()).add(r["line_no"])
    assert got == {h: {4, 5, 6, 7, 9} if i % 2 else {4, 5, 6, 7, 8, 9} for i, (h, _) in enumerate(rows)}


def test_body_lines_of_every_page_of_a_large_template(spark):
    # only pages that don't have the smallest hashes hold the notice: a wrapper of some pages doesn't know it
    first = [r["id"] for r in spark.range(1400).select("id", F.xxhash64(F.concat(F.lit("h"), "id")).alias("x")).orderBy("x").collect()]
    notice = "Orders of this week leave on Monday because of the fair."
    rows = []
    for i, (h, text) in enumerate(site(1400, prose_body)):
        lines = text.split("\n")
        rows.append((h, "\n".join([*lines[:5], notice if i in set(first[700:]) else lines[5], *lines[5:]])))
    content, pages = tables(spark, rows)
    units = wrappers.units(content, pages)
    assert units.select("part").distinct().count() > wrappers.FAN
    made = wrappers.wrappers(content.withColumnRenamed("content", "text"), units.select("hash", "unit", "parts", "part")).collect()
    key = wrappers.key_of(notice)
    assert [(r["unit"], r["pages"], r["shares"][r["keys"].index(key)]) for r in made] == [("t:t1", 1400, 0.5)]
    kept = {(r["hash"], r["line_no"]) for r in wrappers.body_lines(content, pages).collect()}
    assert not any((rows[i][0], 6) in kept for i in first[700:])
    assert all((h, n) in kept for h, _ in rows for n in (4, 5))


def test_residue(spark):
    rows = site(30, prose_body)
    bad = site(1, lambda i: ["Copper kettle", "Hello {{customer.first}}, welcome to ${shop.city}."])[0][1]
    notice = site(1, lambda i: ["Page not found", "The page you were looking for doesn't exist or has been moved."])[0][1]
    about = site(1, lambda i: ["What {{name}} means in a mail template", "When a template prints {{name}} on the page, the value behind the field is missing, so we show the reader how to fill it."])[0][1]
    content, pages = tables(spark, [*rows, ("bad", bad), ("notice", notice), ("about", about), ("empty", ""), ("null", None)])
    model = residue.train(content, pages)
    got = {r["record_key"]: r["kind"] for r in residue.residue_texts(content, pages, model).collect()}
    assert got == {"bad": "filler", "notice": "notice"}
    titles = spark.createDataFrame([(1, "404 Not Found - Lund"), (2, "How to design a kinder 404 page"), (3, "Copper kettle no. 4 - Lund"), (4, None), (5, ""), (6, "{{page.title}}"), (7, "Untitled")], "row_id long, title string")
    assert {r["record_key"] for r in residue.residue_titles(titles, model).collect()} == {"1", "6", "7"}


def test_residue_model_of_all_texts_and_titles(spark):
    rows = [(f"h{i}", f"{prose_body(i)[1]}\nA line for {chr(97 + i % 26)}{chr(97 + i // 26)} only.\n<b>The same in all</b> of them.") for i in range(300)]
    rows += [(f"n{i}", x) for i, x in enumerate([*residue_grammar.notices(600), *residue_grammar.filler(600)])]
    content, pages = tables(spark, [*rows, ("again", rows[0][1]), ("null", None)])
    pages = pages.unionByName(pages).withColumn("title", F.concat(F.lit("A title of the page "), "content_hash", F.element_at(F.array(F.lit(""), F.lit(" | Lund"), F.lit(" - Vik")), (F.rand(1) * 3 + 1).cast("int"))))
    lines = {p for _, t in rows for p in map(wrappers.plain, t.split("\n")) if len(p) > 12}
    want = residue.fit_prose([*lines, *[f"A title of the page {h}" for h, _ in rows], "A title of the page again", "A title of the page null"])
    assert residue.train(content.repartition(5), pages).notice.tolist() == want.notice.tolist()
    # without one text the model is another: no text is left out
    assert residue.train(content.filter("hash <> 'h7'"), pages).notice.tolist() != want.notice.tolist()


def test_residue_headings_of_many_pages_keep_their_weight(spark, monkeypatch):
    monkeypatch.setattr(residue, "TEXTS", 100)
    rows = [(f"h{i}", f"Common questions\nA line for {chr(97 + i % 26)}{chr(97 + i // 26)} only.\n{'A line of two pages.' if i < 2 else 'Oak'}") for i in range(600)]
    content, pages = tables(spark, [*rows, ("again", rows[0][1]), ("null", None)])
    pages = pages.withColumn("title", F.concat(F.lit("A title of all - "), "content_hash"))
    got = {(r["line"], r["title"]): r["n"] for r in residue.prose_lines(content, pages).collect()}
    # once in each part of the texts, and a title once
    assert got[("Common questions", False)] == 6 and got[("A line for aa only.", False)] == 1 and got[("A line of two pages.", False)] in (1, 2)
    assert got[("A title of all", True)] == 1 and len(got) == 603
    model = residue.fit([x for i in range(60) for x in prose_body(i)])
    lines, times = zip(*[(line, n) for (line, _), n in got.items()])
    once = sum(residue._told([x] * n, [1] * n, model) for x, n in zip(lines, times))
    assert residue._told([*lines], [*times], model).tolist() == once.tolist()
    assert residue._told([*lines], [*times], None).tolist() == sum(residue._told([x] * n, [1] * n, None) for x, n in zip(lines, times)).tolist()


def test_residue_titles_behind_a_status_number():
    # shelf marks make the beginning of such titles prose
    model = residue.fit([*(x for i in range(60) for x in prose_body(i)), *[f"{i} - N{chr(97 + i % 26)}" for i in range(100, 600)] * 9])
    titles = ["Not Found", "404 - Not Found", "404 - Not Found — Lund", "404: Not Found", "503 – a novel of the river", "Copper kettle 404 - Not"]
    assert model.titles(titles) == ["notice"] * 4 + [None] * 2


def test_residue_that_shows_only_as_judged(spark):
    rows = site(30, prose_body)
    wrong = garbling.garble("Произошла внутренняя ошибка. Повторите попытку позже.", "cp1251 as cp1252")
    content, pages = tables(spark, [*rows, ("wrong", wrong + "\nGo back")])
    model = residue.train(content, pages)
    got = {r["record_key"]: r["kind"] for r in residue.residue_texts(content, pages, model).collect()}
    assert got == {"wrong": "notice"}
    # what is passed over at once is what sentence() leaves out
    parts = [p for x in [wrong, "Our tea. Lorem ipsum dolor. Our shop is warm.", "404", "{{x}}", *prose_body(1), *residue_grammar.notices(60), *residue_grammar.filler(60)] for p in residue.judged(x)]
    assert model.sentences(parts) == [model.sentence(p) for p in parts] and sum(map(bool, model.sentences(parts))) > 100


def test_no_generated_line_stands_in_a_table():
    import glob

    import pandas as pd

    if not glob.glob("/root/testdata/sf0.1/*.parquet"):
        pytest.skip("no test tables")
    lines = {x for f in (residue_grammar.filler, residue_grammar.fields, residue_grammar.notices, residue_grammar.about) for x in f()}
    held = set()
    for name, column in (("content_store", "content"), ("page_features", "title"), ("page_features", "description"), ("documents", "text")):
        for t in pd.read_parquet(f"/root/testdata/sf0.1/{name}.parquet", columns=[column])[column].dropna():
            held.update(residue.normal(x).strip() for x in t.split("\n"))
    assert len(lines) > 10_000 and not lines & held


def test_residue_of_templates_left_out():
    prose = [x for i in range(400) for x in prose_body(i)]
    for fold in range(residue_grammar.FOLDS):
        model = residue.fit(prose, fold)
        for make, least in ((residue_grammar.notices, 0.7), (residue_grammar.filler, 0.6)):
            unseen = make(300, fold, True)
            assert sum(map(bool, model.lines(unseen))) >= least * len(unseen)


def test_spam(spark):
    rows = site(40, prose_body)
    stuffed = site(1, lambda i: ["Copper kettle", " ".join(["kettle copper cheap buy best tea"] * 20)])[0][1]
    links = site(1, lambda i: ["Kettles", *[f"kettle {chr(97 + k)} https://x{k}.example/{k} best price" for k in range(20)]])[0][1]
    table = site(1, lambda i: ["Kettle", "A fine kettle of copper that the choir of the town has mended twice.", "Material | copper", "Weight | 4 g", "Colour | red"])[0][1]
    content, pages = tables(spark, [*rows, ("stuffed", stuffed), ("links", links), ("table", table), ("empty", ""), ("null", None)])
    assert {r["hash"] for r in prose.spam_pages(content, pages).collect()} == {"stuffed", "links"}


def test_spam_model_of_all_texts(spark):
    rows = [(f"h{i}", "\n".join(prose_body(i))) for i in range(2200)]
    content = tables(spark, [*rows, ("again", rows[0][1]), ("null", None)])[0]
    # the texts with the largest hashes
    last = [r["hash"] for r in content.filter("content is not null").orderBy(F.pmod(F.xxhash64("content"), F.lit(1 << 30)).desc()).limit(40).collect()]
    whole, part = prose.train(content.repartition(3)), prose.train(content.filter(~F.col("hash").isin(last)))
    assert whole.learned > part.learned and prose.train(content).one.tolist() == whole.one.tolist()


def test_spam_pages_judged_together_as_alone():
    pieces = prose.Pieces()
    lines = ["A kettle's spout, the kettle’s lid_and 12 pots!", "Größe: 4 cm\u00a0breit", "日本 tea", "", "Ünter\u2003uns …", "Новый каталог 2024."]
    for line in lines:
        words, classes = pieces.numbers(pieces.line(line))
        got = prose.TOKEN.findall(line if line.isascii() else prose.ODD.sub("", line))
        assert words.tolist() == [prose.number(w.lower()) if w[0].isalnum() else 0 for w in got] and len(classes) == len(got)
    bodies = [*(prose_body(i) for i in range(30)), [], [""], ["kettle kettle kettle"], lines, ["one"]]
    model = prose.ClassModel({prose.number("the"), prose.number("of")}, low=[-9.0] * len(prose.PAGE_WORDS))
    places = [pieces.line(x) for b in bodies for x in b if x]
    given = model.of(*pieces.numbers([i for x in places for i in x]))
    model.learn(np.bincount(prose.ClassModel.counts(given, np.array([len(x) for x in places]), np.array([len([x for x in b if x]) for b in bodies])), minlength=3 * prose.SLOTS))
    together = model.verdicts(bodies, pieces)
    assert together == [model.verdicts([b], prose.Pieces())[0] for b in bodies]
    assert together[30] == together[31] == (None, 0, 0.0, float("inf")) and together[32][1:] != together[33][1:]
    # what a page repeats costs little, whatever the pages beside it say
    assert together[32][3] < min(x[3] for x in together[:30])


def test_medians_are_exact(spark):
    rng = random.Random(3)
    rows = [(i % 3, round(rng.lognormvariate(1, 0.3), 6)) for i in range(1001)] + [(4, 1.5)] * 7
    got, whole = prose.medians(spark.createDataFrame([*rows, (-1, float("inf"))], "k int, v double"))
    for k in range(3):
        assert got[k] == pytest.approx(pd.Series([v for x, v in rows if x == k]).median(), abs=1e-9)
    assert got[3:] == [None] * 4 and whole == pytest.approx(pd.Series([v for _, v in rows]).median(), abs=1e-9)
