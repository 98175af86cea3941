"""The training-data operators against brute force, on small tables that hold
nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from vellum.llm import (graph, html_text, jaccard_join, licences, mixing, nn_descent, packing, quality, queries, recompression,
                        sanitise, suffix_array)
from vellum.llm.common import stored, stored_with
from vellum.llm.queries import BYTE_RANKS, PACK_TOKENIZER, PATTERN, PIECE_MODEL
from vellum.session import checkpoint_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, cls long, `d` string"


def documents(spark, rows):
    """rows of (doc_id, text[, lang[, source]]) with extra columns whose names the operators use themselves."""
    full = [((*r, None, None)[:4]) for r in rows]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, "k", 3, "x") for i, t, lang, s in full], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.expovariate(0.02)), vocabulary)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, repeats inside, null and empty texts, a long text, equal ids."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    passage, other = prose(rng, 64), prose(rng, 33)
    texts += [f"{prose(rng, 15)} {passage}\n{prose(rng, 20)}" for _ in range(12)]
    texts += [f"{other} {prose(rng, 40)} {other}" for _ in range(4)]
    base = prose(rng, 150).split(" ")
    for k in range(90):  # near copies: more than a long list holds
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"edit{k}"
        texts.append(" ".join(copy))
    texts += [texts[3]] * 5 + [texts[70]] * 3 + [" ".join(base).upper()] * 2
    texts += [None, "", " \t\n", "x " * 60, "one two three", "ONE two\tthree", prose(rng, 30_000, 3000), passage * 1]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [rows[0], rows[5], (rows[6][0], rows[7][1]), (None, texts[3]), (None, prose(rng, 25))]
    return rows


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def written(spark, made):
    """Files of each table that ``made`` has stored in the session's shared folder."""
    top = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(top.glob("vellum-*"))
    made()
    return [sorted(f.name for f in t.iterdir() if not f.name.startswith(".")) for t in set(top.glob("vellum-*")) - before]


@pytest.mark.parametrize("module, step", [
    (quality, lambda docs: quality.quality(docs, PIECE_MODEL, BYTE_RANKS, PATTERN)),
    (packing, lambda docs: packing.pack(docs, PACK_TOKENIZER, PATTERN))])
def test_workers_get_few_whole_texts_at_once(spark, monkeypatch, module, step):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual, during = spark.conf.get(rows), []
    monkeypatch.setattr(module, "stored", lambda df: (during.append(int(spark.conf.get(rows))), stored(df))[1])
    step(documents(spark, [(i, f"some words of text {i}", "en") for i in range(20)]))
    assert during[0] <= 1000 and spark.conf.get(rows) == usual


def test_suffix_array_writes_one_small_table(spark, corpus):
    # every part file is a few child processes of its executor where the shared folder is local
    docs = documents(spark, [r for r in corpus if len(r[1] or "") < 20_000]).repartition(5)
    tables = written(spark, lambda: suffix_array.repeated_passages(docs).collect())
    assert len(tables) == 1 and len(tables[0]) == 1


def test_jaccard_join_leaves_few_files_and_no_markers(spark):
    rng = random.Random(8)
    docs = documents(spark, [(i, prose(rng, 40, 9999)) for i in range(30)]).repartition(6)  # no links
    tables = written(spark, lambda: jaccard_join.jaccard_components(docs).collect())
    assert all(len(t) <= 1 for t in tables) and len(tables) <= 13


@pytest.mark.parametrize("copies, most", [(0, 55), (30, 85)])
def test_jaccard_join_runs_few_jobs(spark, copies, most):
    # every job takes memory of the driver: buffers of its broadcasts, a thread for each exchange
    rng = random.Random(8)
    text = prose(rng, 60, 9999)
    docs = documents(spark, [(i, prose(rng, 40, 9999)) for i in range(30)] + [(100 + i, f"{text} and {i}") for i in range(copies)]).repartition(6)
    group = f"jobs-{copies}-{rng.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        assert jaccard_join.one_of_each(docs).count() == 30 + (copies > 0)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) <= most, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


@pytest.mark.parametrize("links, most", [(100_000, 1), (100, 8)])
def test_components_take_as_many_tasks_as_their_links(spark, monkeypatch, links, most):
    # a round of few links had a Python task and a file for each shuffle partition, twice
    monkeypatch.setattr(graph, "LINKS", links)
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(-200, 200)] + [(1000 + 7 * i, 1000 + 7 * (i + 1)) for i in range(100)]
    pairs = [rng.choice([(u, v), (v, u)]) for u, v in chain + [(5000, 5000 + i) for i in range(100)] + chain[:50] + [(9000, 9000)]]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "u long, v long").repartition(40)
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    usual = {k: spark.conf.get(k) for k in names}
    got = []
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        tables = written(spark, lambda: got.extend(tuple(r) for r in graph.components(df).collect()))
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    want = [(x, -200) for x in range(-200, 201)] + [(1000 + 7 * i, 1000) for i in range(101)] + [(5000 + i, 5000) for i in range(100)]
    assert sorted(got) == want
    files = sorted(map(len, tables))
    assert len(files) > 2 and files[-2] <= most  # the first table has the tasks of the given links


def test_stored_tables_leave_no_shuffle_files(spark):
    def shuffles():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.getAllFiles()))

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual, before = spark.conf.get(name), shuffles()
    held = [spark.range(1000).repartition(3, "id") for _ in range(3)]
    for df in held:
        stored(df)
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and spark.conf.get(name) == usual


def test_aggregates_of_stored_rows(spark):
    table, seen = stored_with(spark.range(10).repartition(3), n=F.count(F.lit(1)), most=F.max("id"))
    assert table.count() == 10 and seen == {"n": 10, "most": 9}
    table, seen = stored_with(spark.range(10).where("id > 10"), n=F.count(F.lit(1)), most=F.max("id"))
    assert table.count() == 0 and seen == {"n": 0, "most": None}


def test_recompression_matches_brute_force(spark, corpus):
    got = collected(recompression.substring_dedup(documents(spark, corpus).repartition(7)), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(brute.substring_dedup(corpus), key=repr)


@pytest.mark.parametrize("rounds", [0, 1, 3, 5])
def test_symbols_depend_on_their_interval_alone(rounds):
    """The same words inside other surroundings give the same keys."""
    rng = random.Random(rounds)
    for _ in range(40):
        core = [b"%d" % rng.randint(0, 4) for _ in range(40)]
        seen = []
        for _ in range(2):
            left, right = ([b"%d" % rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
            key, lo, hi = recompression.Block([b" ".join(left + core + right)], 20).symbols(rounds)
            inside = (lo >= len(left)) & (hi <= len(left) + 40)
            seen.append({(int(k), int(a) - len(left), int(b) - len(left)) for k, a, b in zip(key[inside], lo[inside], hi[inside])})
        assert seen[0] == seen[1]


def test_suffix_array_covers_all_repeats(spark, corpus):
    rows = [(i, t) for i, t in corpus[:-5]]  # one text for each id
    found = suffix_array.repeated_passages(documents(spark, rows).repartition(5), least=50).collect()
    got = defaultdict(set)
    for r in found:
        got[r.doc_id].update(range(r.start, r.start + r.n_words))
        assert r.n_words >= 50 and r.other_doc_id is not None
    assert dict(got) == brute.repeats(rows, 50)


def _variants(n=300, seed=3):
    """Texts that share one passage of which each has another part, with words changed:
    the longest matches on one side hide those that are longer on both."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(110)]
    rows = []
    for i in range(n):
        words = [w if rng.random() > 0.03 else f"{w}-{rng.randint(0, 1)}" for w in passage]
        lo = rng.randint(0, 50)
        rows.append((i, " ".join([f"a{i}", *words[lo:lo + rng.randint(48, 70)], f"z{i}"])))
    return rows


@pytest.mark.parametrize("most", [1 << 15, 100, 3])
def test_suffix_array_finds_every_shared_window(spark, most, monkeypatch):
    """Whatever lies between two suffixes in any order, and however many have a head."""
    monkeypatch.setattr(suffix_array, "MOST", most)
    rows = _variants()
    rows += [(1000 + i, t + f" y{i}") for i, (_, t) in enumerate(rows[:40] + rows[:40])]  # equal surroundings
    found = suffix_array.repeated_passages(documents(spark, rows).repartition(5), least=50).collect()
    got = defaultdict(set)
    for r in found:
        got[r.doc_id].update(range(r.start, r.start + r.n_words))
        assert r.is_first == (r.doc_id < r.other_doc_id)
    assert dict(got) == brute.repeats(rows, 50)
    wanted = defaultdict(set)  # documents with a window of each document
    at = defaultdict(set)
    for i, t in rows:
        w = brute.words(t)
        for s in range(len(w) - 49):
            at[tuple(w[s:s + 50])].add(i)
    for ids in at.values():
        for i in ids:
            wanted[i] |= ids - {i}
    smallest = defaultdict(list)
    for r in found:
        smallest[r.doc_id].append(r.other_doc_id)
    assert all(set(o) <= wanted[i] for i, o in smallest.items())
    if most > len(rows):
        assert {i: min(o) for i, o in smallest.items()} == {i: min(o) for i, o in wanted.items() if o}


@pytest.mark.parametrize(("long", "block"), [(64, 128), (4, 128), (10_000, 7)])
def test_jaccard_join_matches_brute_force(spark, corpus, long, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG", long)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = collected(jaccard_join.jaccard_components(documents(spark, corpus).repartition(6)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.jaccard(corpus), key=repr)


def test_one_of_each_group_stays(spark, corpus):
    rows = [*corpus, *corpus[10:20]]
    docs = documents(spark, rows)
    got = jaccard_join.one_of_each(docs)
    assert got.columns == docs.columns
    sets = [brute.shingles(t) for _, t in rows]
    comp = brute.components(len(rows), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    best = {}
    for (i, _), c in zip(rows, comp):
        best[c] = min(best.get(c, (i is None, i or 0)), (i is None, i or 0))
    wanted = [i for (last, i), c in zip(best.values(), best) if sets[c]]
    kept = [r for r in got.collect() if brute.words(r.text)]
    assert sorted(r.doc_id or 0 for r in kept) == sorted(wanted)
    assert got.count() - len(kept) == sum(not s for s in sets)


def test_base_measures_match_brute_force(corpus):
    for _, t in corpus:
        assert quality.base_measures(t or "") == brute.base_quality(t)


def test_quality_rejects_damage_and_keeps_text(spark):
    rng = random.Random(2)
    english = "the of and to in is was for on with that by this from at it as are be which have not had were".split()
    good = [" ".join(rng.choice(english) if rng.random() < 0.5 else "".join(rng.choice(("ra", "ten", "lo", "vis", "mor", "ing")) for _ in range(3))
                     for _ in range(rng.randint(40, 200))) for _ in range(120)]
    bad = [" ".join(w + rng.choice(("###", "%%%", "$$$")) for w in t.split()) for t in good[:6]] + ["€†‡ƒ" * 200, "spam " * 200]
    rows = [(i, t, "en") for i, t in enumerate(good + bad)] + [(900, "too short", "en"), (901, None, None), (902, good[0], None), (902, good[0], None)]
    judged, column = quality.quality(documents(spark, rows), PIECE_MODEL, BYTE_RANKS, PATTERN)
    kept = {(r.doc_id, r[column].kept) for r in judged.collect()}
    assert judged.count() == len(rows)
    assert sum(k for i, k in kept if i < len(good)) >= 0.97 * len(good)
    assert not any(k for i, k in kept if len(good) <= i < 902)
    assert (902, True) in kept and (902, False) not in kept


def test_fertility_counts_come_from_the_vocabularies():
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Hello world, hello", "", "naïve Ünïcode ☃ 😀", "a" * 5000]
    own = Tokenizer.from_file(PACK_TOKENIZER)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for t, r in zip(texts, quality.fertility(texts, PIECE_MODEL, BYTE_RANKS, PATTERN)):
        assert r[0] == len(own.encode(t, add_special_tokens=False).ids) and r[1] == len(sp.encode(t))
        if t:
            assert r[2] == len(t) / r[0] and r[4] == len(t) / r[1]


def test_licence_base_places_match_brute_force(spark):
    rows = [(0, "All rights\nreserved. CC-BY, cc by; GENERAL public License"), (1, None), (2, ""), (3, "general public license " * 3),
            (4, "Licensed under the Apache License, Version 2.0."), (5, "xé cc by"), (6, "cc byé"), (6, "cc byé"), (7, "the mit of license " * 5000)]
    got = licences.scan_licences(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        for i, t in rows:
            if i == r.doc_id:
                n, places = brute.licence_places(t, licences.BASE_PHRASES)
                assert (r.n_words, r.n_base) == (n, len(places))
                assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
                assert r.base_labels == ",".join(sorted({x for _, x in places}))
    labels = {r.doc_id: (r.labels, r.score) for r in got}
    assert labels[4] == ("apache-2.0", 1.0) and labels[7] == ("", 0.0)


def test_suffix_automaton_gives_matching_statistics():
    rng = random.Random(1)
    sequences = [[rng.randint(1, 3) for _ in range(rng.randint(1, 30))] for _ in range(5)]
    a = licences.SuffixAutomaton(sequences)
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randint(1, 4) for _ in range(300)]
    for i, (state, n) in enumerate(a.statistics(text), 1):
        assert n == max((k for k in range(min(i, 30) + 1) if k == 0 or tuple(text[i - k:i]) in runs))
        for s, end in a.places[state] if n else ():
            assert sequences[s][end - n:end] == text[i - n:i]


def test_licence_spans_tolerate_edits():
    s = licences.Scanner(licences.TEMPLATES, licences.BASE_PHRASES)
    words = licences.TEMPLATES["mit"][3].split()
    del words[30], words[50]
    row = s.scan(("some text before. " + " ".join(words) + " and after").encode())
    assert row[5] == "mit" and 0.9 < row[6] < 1


def test_licence_headings_get_their_own_label():
    s = licences.Scanner(licences.TEMPLATES, licences.BASE_PHRASES)
    for label, texts in licences.TEMPLATES.items():
        for t in texts:
            assert label in s.scan(f"some words before. {t} And words after.".encode())[5].split(","), t
    assert s.scan(b"GNU Affero General Public License Version 3, 19 November 2007")[5] == "agpl,gpl"


def test_licence_chains_and_overlaps_match_plain_versions(monkeypatch):
    """Closing chains out of reach and the sorted overlap test change nothing."""
    def plain(runs):
        open_ = []
        for a, t, n in runs:
            for c in open_:
                skip_a, skip_t = a - c[1], t - c[2]
                if -n < skip_a <= licences.MAX_GAP and -n < skip_t <= licences.MAX_GAP and n + min(0, skip_a, skip_t) > 0:
                    c[1], c[2], c[3] = a + n, t + n, c[3] + n + min(0, skip_a, skip_t)
                    break
            else:
                open_.append([a, a + n, t + n, n])
        return sorted((a, b, covered) for a, b, _, covered in open_)

    rng = random.Random(9)
    for _ in range(300):
        runs = sorted({(rng.randint(0, 150), rng.randint(0, 30), rng.randint(1, 9)) for _ in range(rng.randint(0, 60))})
        assert sorted(licences.chains(runs)) == plain(runs)
    s = licences.Scanner(licences.TEMPLATES, licences.BASE_PHRASES)
    words = " ".join(t for texts in licences.TEMPLATES.values() for t in texts).split()
    for _ in range(20):
        text = " ".join(" ".join(words[k:k + rng.randint(3, 40)]) for k in (rng.randrange(len(words)) for _ in range(40)))
        ids = np.array([s.words.get(w, 0) for w in licences.fold(text.encode())], np.int32)
        best = []
        for span in sorted(s.spans(ids, 0, len(ids)), key=lambda x: (-x[3] * (x[2] - x[1]), x[1], x[0])):
            if all(span[1] >= b[2] or span[2] <= b[1] for b in best):
                best.append(span)
        assert s.scan(text.encode())[7] == ",".join(f"{label}:{a}:{b}" for label, a, b, _ in sorted(best, key=lambda b: b[1]))


def test_licence_scan_is_linear_in_the_notices():
    s = licences.Scanner(licences.TEMPLATES, licences.BASE_PHRASES)
    row = s.scan(("Released under the MIT License. a word between that is far enough from the others here now " * 30_000).encode())
    assert row[7].count("mit:") == 30_000


ARTICLES = {
    "latin": "Der kleine Hund und die Katze sind in dem Haus, das auf dem Berg ist und von dem man das Meer sehen kann.",
    "polish": "Dawno temu w małym mieście mieszkał stary zegarmistrz, który każdego ranka otwierał swój sklep przed wschodem słońca.",
    "cyrillic": "Это длинный абзац русской статьи, который рассказывает о том, как люди живут в большом городе и что они делают.",
    "greek": "Αυτό είναι ένα μεγάλο κείμενο που μιλά για τους ανθρώπους της πόλης και για όσα κάνουν εκεί κάθε μέρα του χρόνου.",
    "arabic": "هذا نص طويل يتحدث عن الناس في المدينة الكبيرة وعن الأشياء التي يفعلونها هناك في كل يوم من أيام السنة الطويلة.",
    "hindi": "यह एक लंबा लेख है जो बड़े शहर में रहने वाले लोगों के बारे में बताता है और वे हर दिन क्या करते हैं यह भी कहता है।",
    "han": "今天的天气很好我们一起去公园散步看到了很多花和树大家都非常高兴然后我们回家吃晚饭早早睡觉了因为明天还要上班。",
    "thai": "วันนี้อากาศดีมากเราจึงไปเดินเล่นในสวนสาธารณะด้วยกันและเห็นดอกไม้และต้นไม้มากมายทุกคนมีความสุขมาก",
}


@pytest.mark.parametrize("script", ARTICLES)
def test_page_text_in_every_script(script):
    good = ARTICLES[script]
    page = (f"<body class='has-sidebar'><div id=menu><a href=x>{good[:9]}</a></div><div class='content no-sidebar'><h1>{good[:6]}</h1><p>{good}</p>"
            f"<p>{good[:12]}</p><p>{good}</p></div><div class=sidebar>{good}</div><div class='site-footer'>{good}</div>")
    assert html_text.main_text(page)[0] == "\n".join([good[:6].strip(), good, good[:12].strip(), good])


@pytest.mark.parametrize("page, text", [
    ("<article class='post has-related'><p>Cats sleep.</p></article><div>Other</div>", "Cats sleep."),
    ("<body><p>Cats sleep.</p><p>Dogs bark.</p><p>Birds sing.</p>", "Cats sleep.\nDogs bark.\nBirds sing."),
    ("<div class='content-with-sidebar'><p>Cats sleep.</p></div><div class='left-sidebar'>Tags</div>", "Cats sleep."),
    (f"<div class=widget><p>{ARTICLES['latin']}</p><nav>Menu</nav></div>", ARTICLES["latin"]),
    ("<div><a href=1>Home</a></div><div><a href=2>About</a></div><footer>(c) 2020</footer>", ""),
])
def test_pages_without_decided_content(page, text):
    assert html_text.main_text(page)[0] == text


def test_page_text(spark):
    good = "This is the text of an article that is long enough to be seen as such, and it has the words of a sentence."
    page = (f"<html><head><title>No</title><script>var a='<p>no</p>'</script></head><body class='has-sidebar'><header>Site</header>"
            f"<nav><a href=x>Menu</a></nav><div class=ad>Buy the thing that all of us have</div><article><header><h1>Caf&eacute; &amp;\n tea</h1></header>"
            f"<p>{good}<p>Short.<br>line<p class=ad>advert<aside>{good}</aside><form><p>name</form><p>Last &#x41;</p>"
            f"<section class='comments'><article><p>{good}</article></section></article><div id=sidebar>{good}</div><footer>(c)</footer>")
    plain = f"<body><div id=menu><a>x</a> <a>y</a></div><h2>Head</h2><div>{good}</div><div>Yes</div><div>{good}</div><p class=notice>{good}</p>"
    rows = [(1, "u", page), (2, None, plain), (3, "u", None), (4, "u", ""), (5, "u", "<p>unclosed <!-- x"), (None, "u", page), (1, "u", page)]
    pages = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert html_text.extract(pages).count() == len(rows)
    assert got[1].text == f"Café & tea\n{good}\nShort. line\nLast A" and got[None].text == got[1].text
    assert got[2].text == f"Head\n{good}\nYes\n{good}"
    assert (got[3].text, got[4].text, got[3].n_chars) == ("", "", 0)


def test_personal_data_matches_brute_force(spark):
    rng = random.Random(3)
    alphabet = ["a", "b@c.de", "x.y+z@m-1.org", "@", "1.2.3.4", "256.1.1.1", "01.002.3.255.7", "+1 (555) 123-4567", "4111 1111 1111 1111",
                "4111-1111-1111-1112", "123", " ", "\n", "é", ".", "%", "-", "+", "9" * 25, "😀"]
    texts = ["".join(rng.choice(alphabet) + rng.choice(["", " ", "x "]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    texts += ["a@b.c%d@e.f", "1.2.3.4.5.6.7.8", "+1" + " " * 50 + "23456789", None, "", "7" * 3000, ("4111 1111 1111 1111 " * 40), "a" * 100_000 + "@b.c"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (0, texts[0]), (1, texts[2]), (None, texts[4])]
    got = sanitise.report(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted(((i, *(sum(s[0] == k for s in brute.pii(t)) for k in brute.PII), ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(t)))
                   for i, t in rows), key=repr)
    base = lambda r: ",".join(s for s in r.spans.split(",") if s and not s.startswith("term:"))
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, base(r)) for r in got), key=repr) == want
    import hashlib
    assert all(r.base_sha256 == hashlib.sha256(base(r).encode()).hexdigest() for r in got)


def disclosure_rows():
    rng = random.Random(9)
    common = "the report was sent to our office on that day and the answer came later from there".split()
    rows = [(i, " ".join(rng.choices(common, k=30))) for i in range(200)]
    rows += [(300, "the manager Zebulon, of Quirkville, wrote from z.q@mail.example on that day to our office"),
             (301, "our answer to z.q@mail.example was sent later; Zebulon came"), (302, "Quirkville is a town that the report names"),
             (303, "call +1 (555) 010-9999 or 10.0.0.1 and the office"), (304, "x" * 300 + " 10.0.0.1 " + "ß" * 300), (305, None)]
    # a value whose telling term stands 1,000 characters away, one document's value, a list in two copies, a value in many documents
    filler = " ".join(rng.choices(common, k=250))
    rows += [(310, f"a.b@far.example {filler} Xanthippe"), (311, f"Xanthippe İstanbul {filler} {filler} A.B@far.example"),
             (312, "only here: once@one.example by Singular"), (313, "Singular")]
    listed = " ".join(f"m{k}@list.example Member{k}" for k in range(40))
    rows += [(320, listed), (321, listed), (322, f"{listed} again"), (None, f"again {listed}")]
    rows += [(330 + k, f"{' '.join(rng.choices(common, k=12))} help@hot.example Hotline{k % 3} {' '.join(rng.choices(common, k=5))}") for k in range(90)]
    return rows


def test_personal_data_sends_texts_twice_at_most(spark, monkeypatch, capsys):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with large tables
    try:
        monkeypatch.setattr(sanitise, "stored", lambda df: (df.explain("formatted"), stored(df))[1])
        sanitise.find_spans(documents(spark, disclosure_rows())).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    sent = re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[.*\btext#\d+", capsys.readouterr().out)
    assert 1 <= len(sent) <= 2


def test_disclosing_terms_match_brute_force(spark):
    rows = disclosure_rows()
    got = {}
    for r in sanitise.report(documents(spark, rows)).collect():
        got[r.doc_id] = {tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("term:")}
    want = brute.terms(rows, sanitise.THRESHOLD)
    assert {i: s for i, s in got.items() if s} == {rows[d][0]: s for d, s in want.items()}
    assert {310, 311, 320, 322, None, 330} <= {rows[d][0] for d in want}
    texts = {r.doc_id: r.text for r in sanitise.sanitised(documents(spark, rows)).collect()}
    assert texts[305] is None and texts[302] == rows[202][1] and texts[0] == rows[0][1]
    assert "[email]" in texts[300] and "Zebulon" not in texts[300] and "the manager" not in texts[300].replace("[term]", "the manager")[:0]
    assert "[phone]" in texts[303] and "[ip]" in texts[303] and "office" in texts[303]
    assert texts[310].endswith(" [term]") and texts[311].startswith("[term] İstanbul") and "Singular" in texts[312]


def test_mix_reaches_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 60)), None, rng.choice(["a", "b", "c", "é", "Z", None])) for i in range(400)]
    rows += [(500 + i, prose(rng, 900), None, "big") for i in range(30)] + [(1, None, None, "a"), (2, "", None, "only-empty"), (2, "", None, "only-empty")]
    docs = documents(spark, rows)
    got = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["size"] == len(brute.words(r["doc"].text)) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    key = lambda r: (r["doc"].doc_id, r["source"] or "", r["taken"])
    again = [r.asDict() for r in mixing.mix(docs.repartition(3)).collect()]
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_curriculum_order_and_words(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 20), None, "abc"[i % 3]) for i in range(120)]
    docs = documents(spark, rows)
    stream = mixing.curriculum(mixing.mix(docs)).collect()
    places = [r.position for r in stream]
    assert places == sorted(places) and 0 <= places[0] and places[-1] < 1
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(brute.words(r.text))
    want = brute.targets(dict.fromkeys("abc", 800))
    assert all(abs(words[s] - want[s]) <= 1 for s in "abc")
    early = np.mean([r.position for r in stream if r.source == "a"])
    assert early < 0.5 < np.mean([r.position for r in stream if r.source == "c"])


def test_taken_documents_follow_the_curriculum(spark, monkeypatch, tmp_path):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(1, 40)), None, "abcd"[i % 4]) for i in range(160)]
    rows += [(500 + i, prose(rng, 300), None, "e") for i in range(8)] + [rows[0], (1, None, None, "a"), (None, "x y", None, None)]
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    mixed = mixing.mix(docs).withColumn("doc_id", F.col("doc.doc_id"))
    got = queries.op8_curriculum_mix(spark, str(tmp_path))
    names = "doc_id", "size", "source_size", "target", "taken"
    assert collected(got, *names) == collected(mixed, *names)
    got = got.collect()
    assert any(r.taken == 0 for r in got) and all((r.first_position is None) == (r.taken == 0) for r in got)
    places = [r.first_position for r in got if r.taken]
    assert places == sorted(places) and 0 <= places[0] and places[-1] < 1
    monkeypatch.setattr(mixing.position, "__defaults__", ((0.0, 0.0, 0.0),))
    assert places != [r.first_position for r in queries.op8_curriculum_mix(spark, str(tmp_path)).collect() if r.taken]


@pytest.mark.parametrize("slope", [0.5, 0.0, -0.5])
def test_position_inverts_demand(spark, slope):
    y = [i / 50 for i in range(50)]
    df = spark.createDataFrame([(v * 200, 200.0) for v in y], "o double, t double")
    got = [r[0] for r in df.select(mixing.position(F.col("o"), F.col("t"), F.lit(0), (slope,))).collect()]
    assert [t + slope * (t - t * t) for t in got] == pytest.approx(y)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PACK_TOKENIZER)
    own.encode_special_tokens = True
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([1, 5, 60, 300, 2500]))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "<|endoftext|> x"), (None, "null id"), (3, rows[3][1]), (4, "equal id")]
    pieces = packing.pack(documents(spark, rows), PACK_TOKENIZER, PATTERN).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        total = sum(p.length for p in s)
        assert [p.offset for p in s] == list(np.cumsum([0, *[p.length for p in s]])[:-1])
        assert total <= 1024 and total & (total - 1) == 0
    want = defaultdict(list)
    for i, t in rows:
        want[i].append([*own.encode(t or "", add_special_tokens=False).ids, 0])
    for i, texts in want.items():
        got = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[i])
        assert sum(g[1] for g in got) == sum(map(len, texts))
        for start, n, crc, size in got:
            assert any(len(t) == size and zlib.crc32(np.array(t[start:start + n], "<u4").tobytes()) == crc for t in texts)
        if len(texts) == 1:
            assert [g[0] for g in got] == list(np.cumsum([0, *[g[1] for g in got]])[:-1])


@pytest.mark.parametrize(("shard_tokens", "least"), [(1_500_000, 0.3), (5_000, 0.9)])
def test_pipeline_sequences_follow_the_curriculum(spark, monkeypatch, shard_tokens, least):
    import corpus_pipeline

    monkeypatch.setattr(packing, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(mixing.position, "__defaults__", ((0.9, 0.0, -0.9),))
    rng = random.Random(9)
    docs = documents(spark, [(i, prose(rng, rng.choice([20, 90, 900])), None, "abc"[i % 3]) for i in range(300)])
    stream = [r["doc"].doc_id for r in mixing.curriculum(mixing.mix(docs)).collect()]
    mixed = stored(corpus_pipeline.source_mix(spark, docs.repartition(3), ""))
    place = defaultdict(list)
    for k, i in enumerate(stream):
        place[i].append(k)
    once = {i: k[0] for i, k in place.items() if len(k) == 1}
    pieces = [p for p in corpus_pipeline.sequence_packing(spark, mixed, "").collect() if p.doc_id in once]
    assert np.corrcoef([p.sequence_id for p in pieces], [once[p.doc_id] for p in pieces])[0, 1] > least
    shards = defaultdict(list)
    for p in pieces:
        shards[p.sequence_id >> 32].append(once[p.doc_id])
    assert len(shards) > 1 or shard_tokens > 5_000
    assert all(max(shards[a]) < min(shards[b]) for a, b in zip(sorted(shards), sorted(shards)[1:]))
    full = sorted((p.sequence_id, once[p.doc_id]) for p in pieces if p.length == 1024)
    assert len(full) > 20 and [k for _, k in full] == sorted(k for _, k in full)


def test_packing_takes_null_places_last(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 200)
    rng = random.Random(2)
    rows = [(i, prose(rng, 30), None if i % 3 == 0 else i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank long")
    got = packing.pack(docs, PACK_TOKENIZER, PATTERN, order_col="rank").collect()
    assert {r.doc_id for r in got} == set(range(60))
    placed = max(r.sequence_id >> 32 for r in got if r.doc_id % 3)
    assert all(r.sequence_id >> 32 >= placed for r in got if r.doc_id % 3 == 0)


def test_packing_ids_are_the_tokenizers_on_every_code_point():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PACK_TOKENIZER)
    own.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 2000):
        text = "".join(f"a{c}b {c}{c}  1{c}2 .{c}! {c}\n{c}" for c in map(chr, points[lo:lo + 2000]))
        assert packing.encode(text, PACK_TOKENIZER, PATTERN) == own.encode(text, add_special_tokens=False).ids


def test_packing_recognises_added_tokens(spark, tmp_path):
    """The registered query gives the ids of the tokenizer at its default settings."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PACK_TOKENIZER)
    end = "<|endoftext|>"
    texts = [f"one {end} two", end, f"{end}{end} x", f"a{end}b\n{end}", f"<{end}> <|endoftext |>", "plain", f"{'long ' * 1500}{end} tail"]
    for t in texts:
        assert packing.encode(t, PACK_TOKENIZER, PATTERN, added=True) == own.encode(t, add_special_tokens=False).ids
    documents(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = queries.op9_retrieval_packing(spark, str(tmp_path)).collect()
    want = [[*own.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert sum(p.length for p in pieces) == sum(map(len, want))
    for p in pieces:
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())


def test_packing_puts_related_pieces_together():
    rng = np.random.default_rng(0)
    pieces = []
    for topic in range(20):  # four pieces of 256 tokens on each topic
        own = rng.integers(1000 + 50 * topic, 1050 + 50 * topic, (4, 200))
        pieces += [np.concatenate((own[k], rng.integers(0, 500, 56))) for k in range(4)]
    order = rng.permutation(len(pieces))
    windows = packing.pack_shard([pieces[i] for i in order], np.ones(5000))
    together = sum(len({order[p] // 4 for p, *_ in w}) == 1 for w in windows)
    assert together >= 18


def test_nn_descent_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 24))
    near = base[:20].repeat(15, axis=0) + 0.05 * rng.standard_normal((300, 24))
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]))]
    vectors += [(1000 + k, vectors[5][1]) for k in range(4)] + [(2000, [2 * x for x in vectors[7][1]])]
    odd = [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] + [1.0] * 23), (3004, [None] + [1.0] * 23),
           (3005, [1.0, 0.0]), (3006, [1.0, 0.01]), (3007, [float("inf")] * 24), (None, vectors[9][1]), (3008, [1e200] * 24)]
    df = spark.createDataFrame([(*r, 1) for r in vectors + odd], "vec_id long, embedding array<double>, node long")
    got = {(r.vec_id): (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(df).collect()}
    rows = vectors + odd
    ok = [bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [None if not o else np.array(v) / np.abs(v).max() for o, (_, v) in zip(ok, rows)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    linked = lambda a, b: a != b and ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= 0.95
    comp = brute.components(len(rows), linked)
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if comp[b] == comp[a] and rows[b][0] is not None]
        want = min(ids) if ids else None
        assert got[i] == (sum(linked(a, b) for b in range(len(rows))), want, i == want), i


def test_nn_descent_joins_groups_whose_lists_are_full(spark):
    """Lists hold only the own tight group; the links to the next group lie beyond K."""
    rng = np.random.default_rng(4)
    axes = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    rows = []
    for g in range(6):  # groups g and g + 1 of a chain of three are about 0.96 apart, chains are not linked
        chain, place = divmod(g, 3)
        turn = place * np.arccos(0.96)
        centre = np.cos(turn) * axes[3 * chain] + np.sin(turn) * axes[3 * chain + 1]
        noise = rng.standard_normal((14, 40))
        rows += list(centre + 0.04 * noise / np.linalg.norm(noise, axis=1, keepdims=True))
    unit = np.array([r / np.linalg.norm(r) for r in rows])
    linked = unit @ unit.T >= 0.95
    assert linked[:14, 14:28].mean() > 0.7 and not linked[:42, 42:].any()
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(df).collect()}
    assert got == {i: (int(linked[i].sum()) - 1, 42 * (i // 42)) for i in range(len(rows))}


def test_nn_descent_fails_when_the_audit_misses(spark, monkeypatch):
    rows = [(i, [1.0, 0.001 * i, 0.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(nn_descent, "MAX_ORDERS", nn_descent.ORDERS)
    monkeypatch.setattr(nn_descent, "audit", lambda *_: (5, 0.5))
    with pytest.raises(RuntimeError, match="recall"):
        nn_descent.near_duplicates(df)


def test_empty_tables(spark):
    docs = documents(spark, [(1, "x")]).where("doc_id > 5")
    assert recompression.substring_dedup(docs).count() == 0
    assert suffix_array.repeated_passages(docs).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == 0 and jaccard_join.one_of_each(docs).count() == 0
    assert quality.quality(docs, PIECE_MODEL, BYTE_RANKS, PATTERN)[0].count() == 0
    assert licences.scan_licences(docs).count() == 0
    assert sanitise.report(docs).count() == 0 and sanitise.sanitised(docs).count() == 0
    assert mixing.mix(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    assert packing.pack(docs, PACK_TOKENIZER, PATTERN).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nn_descent.near_duplicates(vectors).count() == 0
