"""The text operators against brute force, on small fixtures with nulls, copies, ties and odd texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bwt_repeats, jaccard_join, language_id, quality_classifier, quality_rules, sentencepiece_bpe, source_mixing, substring_dedup, suffix_dedup, textscan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string"


def corpus(n=60, seed=1):
    """Rows with exact and near copies, a shared passage, null, empty, blank and one-word texts, and a column of a clashing name."""
    r = random.Random(seed)
    vocabulary = ["lorem", "ipsum", "dolor", "sit", "amet", "été", "straße", "niño", "x", "1.5", "C++", "—"]
    passage = " ".join(r.choice(vocabulary) + str(k) for k in range(80))
    rows = []
    for i in range(n):
        text = " ".join(r.choice(vocabulary) + str(r.randrange(400)) for _ in range(r.randrange(1, 160)))
        if i % 7 == 0:
            text = text + "\n" + passage + " \t" + text[:50]
        if i % 10 == 9 and rows:
            text = rows[-1][1] or text
        if i % 10 == 8 and rows:
            text = (rows[-1][1] or "") + " tail"
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 3}", len(text), "clash"))
    rows += [(n, None, None, None, None, "clash"), (n + 1, "", "en", None, 0, "clash"), (n + 2, " \t\n", "fr", "s1", 3, "clash"), (n + 3, "one", "en", "s0", 3, "clash"), (n + 4, "ab " * 3000, "en", "s0", 9000, "clash")]
    return [*rows, rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_statistics_match_a_plain_count():
    import pyarrow as pa

    from spanloom.llm.runtime import buffers

    texts = [r[1] for r in corpus()] + ["a b c a b c", "x\nx\n\nx y\nx y", "#|<> é"]
    got = textscan.statistics(*buffers(pa.array(texts)))
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        tri = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + j for k in range(len(words) - 2) if tri[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got["n_unique_words"][i] == len(set(words))


def test_trees_learn_and_stay_monotonic():
    r = np.random.default_rng(0)
    x = r.uniform(0, 1, (2000, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.2)).astype(float)
    trees = quality_rules.fit_trees(x, y, np.array([-1, 0, 0]))
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.98
    probe = np.tile(r.uniform(0, 1, (50, 1, 3)), (1, 40, 1))
    probe[:, :, 0] = np.linspace(0, 1, 40)
    assert (np.diff(trees.score(probe.reshape(-1, 3)).reshape(50, 40), axis=1) <= 1e-12).all()
    assert quality_rules.fit_trees(np.zeros((0, 3)), np.zeros(0), np.zeros(3)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_rules_and_classifier(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0, "clash") for i in range(60)] + [(1, None, 0, "clash"), (None, 1, 0, "clash")], "doc_id long, quality int, toxic int, text string")
    rows = quality_rules.apply_rules(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed) for r in rows)
    scored = quality_classifier.score_quality(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert quality_rules.apply_rules(empty, labels).count() == quality_classifier.score_quality(empty, labels).count() == 0
    none = labels.where("false")
    assert {r.kept for r in quality_rules.apply_rules(docs, none).collect() if not r.base_failed} == {True}
    assert {r.score for r in quality_classifier.score_quality(docs, none).collect()} == {0.5}


def test_isotonic_is_the_nearest_rising_sequence():
    assert quality_classifier.isotonic(np.array([1.0, 0.0, 2.0, 2.0]), np.array([1.0, 1.0, 1.0, 1.0])).tolist() == [0.5, 0.5, 2.0, 2.0]
    assert quality_classifier.isotonic(np.zeros(0), np.zeros(0)).tolist() == []


def test_language(spark, docs, empty):
    r = random.Random(2)
    words = {"en": ["the", "house", "which", "water"], "fr": ["été", "maison", "où", "l'eau"], "de": ["straße", "häuser", "welche", "wässer"]}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(12)), x) for i in range(240) for x in [("en", "fr", "de")[i % 3]]] + [(900, None, "en"), (901, "12 !? ", "en"), (None, "the house", "en"), (902, "the water", None)]
    got = {x.doc_id: x for x in language_id.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in rows[:240]) >= 238
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert language_id.predict_language(empty).count() == 0
    assert {x.lang_pred for x in language_id.predict_language(docs.withColumn("lang", docs.lang.substr(9, 1))).collect()} <= {"", "und"}


def test_sentencepiece_equals_the_library(spark, docs, empty):
    from public_tokenizers import path
    from sentencepiece import SentencePieceProcessor

    model = path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=model)
    r = random.Random(3)
    odd = ["  lead", "trail  ", "a  b   c", "▁x ▁", "你好 😀", "a\x00b", "</s> <unk>", " " * 37, "aaaa" * 300, "é‍", *("".join(r.choice("abcdehit  \nß▁😀.,") for _ in range(r.randrange(50))) for _ in range(500))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string").unionByName(docs.select((docs.doc_id + 10_000).alias("doc_id"), "text"))
    texts = {x.doc_id: x.text for x in rows.collect()}
    got = sentencepiece_bpe.encode_documents(rows, model).collect()
    assert len(got) == rows.count()
    for x in got:
        want = library.encode(texts[x.doc_id] or "") + [2]
        assert x.ids == want and x.decoded == library.decode(want)
    assert sentencepiece_bpe.encode_documents(empty, model).count() == 0
    m = sentencepiece_bpe.PieceModel(model)
    for _ in range(300):
        ids = [r.randrange(32000) if r.random() < 0.6 else r.randrange(260) for _ in range(r.randrange(8))]
        assert m.decode(ids) == library.decode(ids) == sentencepiece_bpe.decode_batch(m, np.array(ids, np.int32), np.array([0, len(ids)]))[0]


def test_repeated_starts_by_brute_force():
    r = np.random.default_rng(1)
    for _ in range(150):
        s = r.integers(0, r.integers(1, 5) + 1, r.integers(2, 150)).astype(np.uint8)
        d = int(r.integers(1, 12))
        c = Counter(bytes(s[i : i + d]) for i in range(len(s) - d + 1) if 0 not in s[i : i + d])
        want = [i + d <= len(s) and 0 not in s[i : i + d] and c[bytes(s[i : i + d])] > 1 for i in range(len(s))]
        assert bwt_repeats.repeated_starts(s, d).tolist() == want
    assert bwt_repeats.repeated_starts(np.zeros(0, np.uint8), 3).tolist() == []


def plain_removal(units, length):
    count = Counter(tuple(u[i : i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if count[tuple(u[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


@pytest.mark.parametrize("most", [1 << 20, 1500, 200])
def test_suffix_dedup(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_BYTES", most)  # 200, 1500: most anchors go the way of hot ones, all the way or some of it
    rows = docs.collect()
    data = [(r.text or "").encode() for r in rows]
    want = Counter()
    for r, d, gone in zip(rows, data, plain_removal(data, 100), strict=True):
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        want[r.doc_id, len(d), sum(gone), sum(g and not p for g, p in zip(gone, [False, *gone], strict=False)), hashlib.sha256(kept).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, 100).collect())
    assert got == want and sum(k[2] for k in got) > 0
    assert suffix_dedup.remove_repeats(empty, 100).count() == 0


def test_without_repeats_keeps_characters(docs):
    before = {r.doc_id: r.text for r in docs.collect()}
    rows = suffix_dedup.without_repeats(docs, 100).collect()
    assert len(rows) == docs.count() and any(r.text != before[r.doc_id] for r in rows)
    for r in rows:
        assert r.words == "clash" and (before[r.doc_id] is None) == (r.text is None)
        assert r.text is None or "�" not in r.text


def test_periodic_text_is_one_row_a_run(spark):
    """One letter or one phrase again and again takes a few rows, not one a window; what is removed stays exact."""
    texts = ["a" * 20000, "ab " * 5000, "xyz" + "a" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert suffix_dedup.segment_table(suffix_dedup.keyed(rows), 100).count() < 60
    data = [t.encode() for t in texts]
    want = {i: sum(g) for i, g in enumerate(plain_removal(data, 100))}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(rows, 100).collect()} == want
    words = [WORD.findall(t) for t in texts]
    want = {i: sum(g) for i, g in enumerate(plain_removal(words, 35))}
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeated_words(rows).collect()} == want


def test_without_repeats_keeps_clashing_columns(spark):
    names = ["doc_id", "text", "tk", "h", "spans", "row", "kept"]
    rows = spark.createDataFrame([(i, "z" * 300 if i < 2 else "short", f"k{i}", 1, 2, 3, 4) for i in range(3)], ", ".join(f"{n} {'string' if n in ('text', 'tk') else 'long'}" for n in names))
    got = suffix_dedup.without_repeats(rows, 100)
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == [(0, "", "k0", 1, 2, 3, 4), (1, "", "k1", 1, 2, 3, 4), (2, "short", "k2", 1, 2, 3, 4)]


def test_substring_dedup(docs, empty):
    rows = docs.collect()
    words = [WORD.findall(r.text or "") for r in rows]
    for length in (35, 10):
        want = Counter((r.doc_id, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for r, w, g in zip(rows, words, plain_removal(words, length), strict=True))
        assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeated_words(docs, length).collect()) == want
    assert substring_dedup.remove_repeated_words(empty).count() == 0


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_join(spark, docs, empty, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # 2: nodes are cut into pairs of chunks
    rows = docs.collect()
    sets = []
    for r in rows:
        w = WORD.findall(r.text or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    link = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    root = [r.doc_id for r in rows]
    for _ in rows:
        root = [min([root[i], *(root[j] for j in link[i])]) for i in range(len(rows))]
    want = Counter((r.doc_id, root[i], len(link[i]), len(sets[i])) for i, r in enumerate(rows))
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in jaccard_join.forest_join(docs).collect())
    assert got == want and max(k[2] for k in got) >= 2
    assert jaccard_join.forest_join(empty).count() == 0
    assert jaccard_join.depth_for(0.8, 0.9999) == 4 and jaccard_join.depth_for(0.99, 0.9999) == 6


def test_jaccard_join_ids(spark):
    """Rows without an id take part, texts of one id count by themselves, and one row a class stays."""
    a = " ".join(f"a{k}" for k in range(60))
    b = " ".join(f"b{k}" for k in range(60))
    rows = [(None, a), (7, a + " x"), (7, b), (None, b + " y z"), (3, "lone text of some words"), (None, "quite another text of words"), (None, None), (9, ""), (3, "lone text of some words")]
    df = spark.createDataFrame([(i, t, f"c{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, tk string")
    got = Counter((r.doc_id, r.class_id, r.n_links, r.rep_id) for r in jaccard_join.forest_join(df).collect())
    assert got == Counter([(None, 7, 1, None), (7, 7, 1, 7), (7, 7, 1, 7), (None, 7, 1, None), (3, 3, 1, 3), (3, 3, 1, 3), (None, None, 0, None), (None, None, 0, None), (9, 9, 0, 9)])
    kept = jaccard_join.distinct_documents(df)
    assert kept.columns == df.columns
    assert sorted(r.tk for r in kept.collect()) == ["c1", "c2", "c4", "c5", "c6", "c7"]
    assert jaccard_join.distinct_documents(df.where("false")).count() == 0


def test_forest_meets_pairs_at_their_longest_prefix(spark):
    """Each pair is met once, where its labels agree longest; the chance of it is what is measured."""
    r = np.random.default_rng(4)
    n, floor = 40, 4
    base = r.integers(0, 1 << 60, jaccard_join.TREES)
    labels = np.array([[x if r.random() < 0.1 else (x >> (10 * (c := int(r.integers(0, 7))))) << (10 * c) | int(r.integers(0, 1 << (10 * c))) for x in base.tolist()] for _ in range(n)], np.int64)
    import pyarrow as pa

    met = Counter()
    for t in range(jaccard_join.TREES):
        for node in np.unique(labels[:, t] >> 20):
            rows = np.flatnonzero(labels[:, t] >> 20 == node)
            rows = rows[np.argsort(labels[rows, t], kind="stable")]
            one = np.zeros(len(rows), np.int32)
            part = pa.table({"tree": one + t, "node": np.full(len(rows), node), "c1": one, "c2": one, "chunk": one, "label": labels[rows, t], "trees": pa.array(labels[rows].tolist(), pa.list_(pa.int64()))})
            a, b, depth, _ = jaccard_join.node_pairs(part, floor)
            met.update((*sorted((int(rows[x]), int(rows[y]))), int(d)) for x, y, d in zip(a, b, depth, strict=True))
    want = Counter()
    for i in range(n):
        for j in range(i + 1, n):
            best = max(max((d for d in range(7) if x >> (10 * (6 - d)) == y >> (10 * (6 - d))), default=0) for x, y in zip(labels[i].tolist(), labels[j].tolist(), strict=True))
            if best >= floor:
                want[i, j, best] += 1
    assert met == want and len({k[2] for k in want}) == 3


def test_mixing(docs, empty):
    assert source_mixing.targets([100, 100, 100], (1, 2, 3)) == [50.0, 100.0, 150.0]
    assert source_mixing.targets([600, 10, 10], (1, 2, 3)) == [560.0, 30.0, 30.0]
    split = source_mixing.split_quotas(np.array([7, 0, 30]), 5, np.random.default_rng(0))
    assert split.sum(0).tolist() == [7, 0, 30] and set(split.sum(1)) <= {7, 8}
    rows = source_mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, source_mixing.targets([sizes[s] for s in order]), strict=True))
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == len(r.shards) * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 20 for s in order)
    again = Counter((r.doc_id, r.taken, tuple(r.shards)) for r in source_mixing.mix_sources(docs.repartition(3)).collect())
    assert again == Counter((r.doc_id, r.taken, tuple(r.shards)) for r in rows)
    assert source_mixing.mix_sources(empty).count() == 0


def plain_mix(rows, seed=17):
    """op8's draw replayed in plain Python from the plan of blocks: rows (doc_id, tk, source, size) to copies taken."""
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r[3] for r in rows if r[2] == s) for s in order}
    target = source_mixing.targets([sizes[s] for s in order])
    blocks = {i: np.array([sum(r[3] for r in rows if r[2] == s)], np.int64) for i, s in enumerate(order)}
    plan, wanted = source_mixing.plan_blocks(blocks, target, 16, seed)
    out = {}
    for s, _, shards, edge in plan:
        left = wanted.get(s, 0)
        for r in sorted((r for r in rows if r[2] == order[s]), key=lambda r: -r[3]):
            fits = not edge or r[3] <= left
            left -= r[3] if edge and fits else 0
            out.setdefault((order[s], r[3]), []).append(len(shards) - (not fits))
    return {k: sorted(v) for k, v in out.items()}


def test_mixing_equals_a_plain_replay(spark, docs):
    """Every source here is one block, so what is taken of each size follows from the plan alone."""
    rows = [(r.doc_id, 0, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    got = {}
    for r in source_mixing.mix_sources(docs).collect():
        got.setdefault((r.source, r.size), []).append(len(r.shards))
    assert {k: sorted(v) for k, v in got.items()} == plain_mix(rows)


def test_mixed_documents_keep_rows(spark, docs, empty):
    """Copies of one row are taken together, rows of null id take part, and columns of clashing names stay."""
    rows = docs.withColumn("doc_id", F.expr("case when doc_id % 4 = 0 then null else doc_id end")).withColumnRenamed("words", "shard")
    got = source_mixing.mixed_documents(rows)
    assert got.columns == rows.columns
    taken = Counter((r.doc_id, r.text, r.source, r.shard) for r in got.collect())
    have = Counter((r.doc_id, r.text, r.source, r.shard) for r in rows.collect())
    assert taken.keys() <= have.keys() and all(taken[k] % n == 0 and taken[k] <= 3 * n for k, n in have.items())
    assert any(k[0] is None for k in taken) and source_mixing.mixed_documents(empty).count() == 0


def test_accepted_equals_the_rules(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "doc_id long, quality int")
    kept = Counter(r.doc_id for r in quality_rules.apply_rules(docs, labels).where("kept").collect())
    got = quality_rules.accepted(docs, labels)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == kept
    assert quality_rules.accepted(empty, labels).count() == 0


def test_language_counts_by_hand(spark, monkeypatch):
    """The table of log-probabilities from n-grams counted one by one, and the predictions from it; of too many languages the commonest are learnt."""
    from spanloom.llm.textscan import keys64

    rows = [(i, t, x) for i, (t, x) in enumerate([("Ab 1!", "u"), ("bab", "u"), ("zÀz 22", "v"), ("z  z", "v"), ("abz", "w"), ("", "u")] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    keys = keys64(3, 71).astype(np.uint32)

    def plain(text):
        code = [ord(c.lower()) if c.isalpha() else 0x30 if c.isdigit() else 0x20 for c in text]
        out = Counter()
        for n in (1, 2, 3):
            for k in range(len(code) - n + 1):
                h = 0
                for j in range(n):
                    h = ((h ^ code[k + j]) * int(keys[j])) & 0xFFFFFFFF
                    h ^= h >> 15
                if any(c != 0x20 for c in code[k : k + n]):
                    out[((h * 0x9E3779B1) & 0xFFFFFFFF) >> 18] += 1
        return out

    langs, table, prior = language_id.fit_languages(df.select("text", "lang"))
    assert langs == ["u", "v", "w"]
    for i, x in enumerate(langs):
        count = sum((plain(t) for _, t, l in rows if l == x), Counter())
        seen = np.full(language_id.BUCKETS, 0.5)
        for bucket, n in count.items():
            seen[bucket] += n
        assert np.allclose(table[:, i], np.log(seen / seen.sum()))
    assert np.allclose(np.exp(prior), [0.5, 1 / 3, 1 / 6])
    train = {r.doc_id for r in df.where("crc32(cast(doc_id as string)) % 3 != 1").select("doc_id").collect()}
    langs, table, prior = language_id.fit_languages(df.where(F.col("doc_id").isin(list(train))).select("text", "lang"))
    for r in language_id.predict_language(df).collect():
        text = rows[r.doc_id][1]
        margin = prior + sum((n * table[b] for b, n in plain(text).items()), np.zeros(len(langs)))
        best = int(margin.argmax())
        want = ("und", 0.0) if not text else (langs[best], 1 / np.exp(margin - margin.max()).sum())
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-9 and r.held_out == (r.doc_id not in train)
    assert language_id.fit_languages(df.select("text", "lang"), most=2)[0] == ["u", "v"]


def test_quality_fit_by_plain_algebra(spark):
    """Ridge weights from the normal equations over all rows at once, and the calibration by pooling neighbours until they ascend."""
    from spanloom.llm.textscan import COUNTS, ratios

    r = np.random.default_rng(7)
    n = 400
    count = {c: r.integers(1, 500, n) for c in COUNTS}
    y = (count["n_words"] + r.normal(0, 120, n) > 250).astype(int)
    df = spark.createDataFrame([(*(int(count[c][i]) for c in COUNTS), int(y[i])) for i in range(n)], ", ".join(f"{c} long" for c in COUNTS) + ", y int").repartition(7)
    model = quality_classifier.fit_classifier(df)
    x = ratios(count)
    assert np.allclose(model.fourier.mean, x.mean(0))
    z = model.fourier(x)
    penalty = np.diag([*[1e-4 * n] * (z.shape[1] - 1), 1e-9 * n])
    raw = z @ np.linalg.solve(z.T @ z + penalty, z.T @ y)
    assert np.allclose(model.raw(x), raw, atol=1e-6)
    cell = model.cell(model.raw(x))
    full = np.unique(cell)
    groups = [[y[cell == c].mean(), (cell == c).sum()] for c in full]
    steps = [[v, w, 1] for v, w in groups]
    k = 0
    while k < len(steps) - 1:  # pool any two neighbours that don't ascend, from the left, until all do
        if steps[k][0] >= steps[k + 1][0]:
            (v, w, m), (v2, w2, m2) = steps[k], steps[k + 1]
            steps[k : k + 2] = [[(v * w + v2 * w2) / (w + w2), w + w2, m + m2]]
            k = max(0, k - 1)
        else:
            k += 1
    want = np.maximum.accumulate(np.concatenate([np.full(m, (v * w + y.mean()) / (w + 1)) for v, w, m in steps]))
    assert np.allclose(model.calibrated[full], np.clip(want, 0, 1))
    assert (np.diff(model.calibrated) >= -1e-12).all() and ((model.score(x) >= 0.5) == y).mean() > 0.7


def test_trees_by_plain_recursion(spark, docs):
    """What the rules keep follows from walking every tree node by node."""
    from spanloom.llm.docstats import doc_stats
    from spanloom.llm.textscan import COUNTS, RATIOS, ratios

    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 60, 2)], "doc_id long, quality int")
    trees = quality_rules.fit_rules(doc_stats(docs), labels)
    rows = doc_stats(docs).collect()
    x = ratios({c: np.array([r[c] for r in rows]) for c in COUNTS})

    def walk(node, row):
        if trees.left[node] == node:
            return trees.value[node]
        return walk((trees.left if row[trees.feature[node]] <= trees.threshold[node] else trees.right)[node], row)

    assert len(trees.roots) and x.shape[1] == len(RATIOS)
    plain = [trees.base + sum(walk(root, row) for root in trees.roots) for row in x]
    want = Counter((r.doc_id, r.n_words, bool(r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words and 1 / (1 + np.exp(-m)) >= 0.5)) for r, m in zip(rows, plain, strict=True))
    assert Counter((r.doc_id, r.n_words, r.kept) for r in quality_rules.apply_rules(docs, labels).collect()) == want
