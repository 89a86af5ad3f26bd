"""Each operator against a brute-force version or held-out labels, with nulls, empty and repeated rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.llm import common, labelled, lattice, mixing, near_dup, neighbours, packing, pii, quality, repeats, rules, toxicity
from marketlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    docs = common.read_table(spark, SF, "documents")
    long = "lorem ipsum dolor " * 3000
    odd = [
        (None, "a text without an id but with words", "en", "s", 3),
        (-1, None, None, None, None),
        (-2, "", "en", "s", 0),
        (-3, " \n\t ", "en", "s", None),
        (-4, "one two", "en", "s", 7),
        (-5, "one two", "en", "s", 7),
        (-5, "one two", "en", "s", 7),
        (-6, long, "en", "s", 1),
        (-7, "x" * 1200, "en", "s", 1),
        (-8, "É  mail a@b.co, a@b.co%c@d.org 1.2.3.4 300.1.1.1 4111 1111 1111 1111 +1 (555) 123-4567 <|endoftext|>", "en", "s", 1),
    ]
    both = docs.unionByName(spark.createDataFrame(odd, DOCS)).withColumn("score", F.lit(1)).withColumn("p", F.lit("x"))
    return both.cache(), [(r.doc_id, r.text) for r in both.collect()]


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(spark, corpus):
    docs, rows = corpus
    sets = {}
    for k, (_, text) in enumerate(rows):
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORDS.findall(text or "")]
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    label = {k: row[0] for k, row in enumerate(rows)}
    for _ in range(len(rows)):
        before = dict(label)
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and label[i] is not None and label[j] is not None:
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    want = Counter((row[0], len(sets[k]), label[k], row[0] is None or row[0] == label[k]) for k, row in enumerate(rows))
    got = near_dup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_rows_that_share_an_id(spark):
    """An empty row beside a text of the same id links nothing; texts that only share a bucket stay apart."""
    one, other = " ".join(f"w{k}" for k in range(300)), " ".join(f"v{k}" for k in range(300))
    rows = [(1, one), (1, ""), (2, one + " end"), (2, None), (3, other), (3, ""), (4, " ".join(other.split()[:250])), (5, other.replace("v9", "u9"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3 if _alike(other, other.replace("v9", "u9")) else 5)}
    empties = spark.createDataFrame([(6, "a b c d e"), (6, ""), (7, "f g h i j"), (7, "")], "doc_id bigint, text string")
    pairs = spark.createDataFrame([(6, 7)], "a bigint, b bigint")
    members = spark.createDataFrame([(6,), (7,)], "node bigint")
    assert near_dup.confirmed(near_dup.sets_of(empties, members), pairs).count() == 0


def _alike(a: str, b: str) -> bool:
    x, y = ({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b))
    return 100 * len(x & y) >= 75 * len(x | y)


def test_rare_shingles_lose_no_link(spark, corpus):
    """Sets that share a shingle list give every link between components that comparing all sets gives, and few other pairs."""
    random = np.random.default_rng(3)
    sets = [np.sort(random.choice(60, random.integers(44, 56), replace=False)).astype(np.uint64) * np.uint64(2**40 + 1) for _ in range(60)]
    sets += [np.concatenate([np.arange(80), 1000 * k + np.arange(20)]).astype(np.uint64) for k in range(1, 80)]
    held = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "node bigint, shingles binary")
    nodes = spark.createDataFrame([(k, k % 5 if k < 60 else k) for k in range(len(sets))], "node bigint, component bigint")
    got = {tuple(x) for x in near_dup.links_between(held, nodes).collect()}
    want = set()
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if (a % 5 != b % 5 if b < 60 else True) and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                want.add((a, b))
    assert got == want and want

    # 79 sets with 80 of 100 shingles in common are no links, and no pair of them comes out to be looked at.
    family = held.filter("node >= 60").withColumn("set", F.col("node"))
    known = family.select("set", "node", F.lit(100).cast("bigint").alias("n"), F.col("node").alias("component"))
    lists = near_dup.postings(family, known)
    assert lists.count() > 0 and near_dup.candidates(lists).count() == 0


def test_one_component_in_a_list_meets_nobody(spark):
    """A hot list costs what lies outside its commonest component."""
    rows = [(7, 1, k, 10, 1 if k < 900 else k) for k in range(902)]
    held = spark.createDataFrame(rows, "shingle bigint, at bigint, node bigint, n bigint, component bigint")
    assert near_dup.candidates(held).count() == 2 * 900 + 1
    assert near_dup.candidates(held.filter("node < 900")).count() == 0


def test_packing_is_whole(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, rows = corpus
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = Tokenizer.from_file(path)
    want = Counter((d, np.array(coder.encode(t or "", add_special_tokens=False).ids + [2], np.uint32).tobytes()) for d, t in rows)
    got = packing.pack(docs, path, 2).collect()
    places = {}
    for r in got:
        assert r.length * 4 == len(r.ids)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 4096
    joined = {}
    for r in sorted(got, key=lambda r: r.start):
        joined.setdefault(r.doc_id, []).append(r)
    for doc, text in {k[0]: k[1] for k in want if sum(n for (d, _), n in want.items() if d == k[0]) == 1}.items():
        assert b"".join(r.ids for r in joined[doc]) == text
    padding = sum(4096 - sum(n for _, n in p) for p in places.values() if bin(sum(n for _, n in p)).count("1") > 1)
    assert padding < 0.005 * sum(r.length for r in got)
    assert packing.pack(empty(spark), path, 2).count() == 0


def test_packing_keeps_all_limits():
    packer = packing.Packer(packing.Limits(tokens=64, segments=3, loss=40, least=2), 0, waiting=16)
    random = np.random.default_rng(1)
    sizes = random.integers(1, 100, 80).tolist()
    bears = [int(n * random.random()) for n in sizes]
    for k, (n, b) in enumerate(zip(sizes, bears)):
        packer.add((k,), n, b)
    packer.fill(0)
    sequences, covered = {}, Counter()
    for (k,), start, n, sequence, _ in packer.out:
        sequences.setdefault(sequence, []).append((n, max(0, start + n - max(start, bears[k]))))
        covered.update((k, i) for i in range(start, start + n))
    assert covered == Counter((k, i) for k, n in enumerate(sizes) for i in range(n))
    for pieces in sequences.values():
        assert len(pieces) <= 3 and sum(n for n, _ in pieces) <= 64 and sum(x for _, x in pieces) <= 40


def test_lattice_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab"]
    weights = np.concatenate([np.arange(1, 8) / 40, np.full(256, 1e-4), [0.1]])
    model = lattice.Lattice(pieces, weights)

    def total(text):
        if not text:
            return 1.0
        out = sum(weights[k] * total(text[len(x) :]) for k, x in enumerate(pieces) if text.startswith(x))
        return out + (weights[7 + text[0]] * total(text[1:]) if bytes([text[0]]) not in pieces else 0)

    words = [b"", b"a", b"abab", b"bxa", "é".encode()]
    assert np.allclose(10 ** model.scores(words), [total(b" " + w) * 0.1 for w in words])
    uses = model.expected([b"abab"], np.ones(1))
    assert math.isclose(sum(uses[k] * len(x) for k, x in enumerate(pieces)) + uses[7:-1].sum(), 5)


def test_lattice_base_scores(spark, corpus):
    import public_tokenizers

    docs, rows = corpus
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    split = [(d, WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for d, t in rows]
    counts = Counter(w for d, words in split if not held(d) for w in [*words, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(d), held(d), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), 6))
        for d, w in split
    )
    found = lattice.score_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), common.crc_mod("doc_id", 7) == 2, class_col="lang").collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_repeats(spark, corpus):
    docs, rows = corpus
    raw = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + 400] for _, b in raw for i in range(len(b) - 399))
    want = Counter()
    for d, b in raw:
        mark = np.zeros(len(b) + 1, np.int64)
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                mark[i] += 1
                mark[i + 400] -= 1
        gone = np.cumsum(mark)[: len(b)] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[d, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    assert got == want
    assert repeats.remove_repeats(empty(spark)).count() == 0


def test_repeats_of_many_units(spark, corpus, monkeypatch):
    """The way for hashes with very many units gives the same rows."""
    docs, _ = corpus
    want = Counter(map(tuple, repeats.remove_repeats(docs).collect()))
    monkeypatch.setattr(repeats, "LARGE", 0)
    assert Counter(map(tuple, repeats.remove_repeats(docs).collect())) == want


def test_neighbours(spark, corpus):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(400, 16)).astype(np.float32)
    vectors[100:160] = vectors[0]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    odd = [(500, None), (520, [0.0] * 16), (540, [float("nan")] * 16), (560, [None] * 16), (None, rows[1][1]), (580, [1.0])]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        score = vectors.astype(float) @ vectors[q].astype(float)
        order = [k for k in sorted(range(400), key=lambda k: (-score[k], k)) if k != q][:20]
        found = [v for _, v, _ in sorted(found)]
        assert len(found) == 20
        hits += len(set(found) & set(order))
    assert hits >= 0.95 * 20 * len(got)
    assert [v for _, v, _ in sorted(got[0])] == list(range(100, 120))


def test_pii_base(corpus):
    _, rows = corpus
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    tests = [t or "" for _, t in rows if t is None or len(t) < 5000] + ["a@b.c%d@e.f", "@x.y a@b@c.d", "1.2.3.4.5.6.7.8", "001.2.3.4", "9" * 50 + ".1.2.3"]
    for text in tests:
        found = pii.base_spans(text)
        assert [(s, e) for k, s, e in found if k == 0] == [m.span() for m in email.finditer(text)]
        assert [(s, e) for k, s, e in found if k == 1] == [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_pii_spreads_labels():
    texts = [f"word {k} mail user{k}.{k}@mail{k % 9}.example.com and 4111111111111111 end" for k in range(300)] + ["year 1999 item 42"] * 300
    model = pii.fit(texts)
    ((base, every),) = pii.find(["4111111111111111 then\nid:4111111111111111x and 1999"], model)
    assert [k for k, _, _ in base] == [2, 2] and set(base) <= set(every)
    ((base, every),) = pii.find(["in 1999 nothing 42"], model)
    assert base == every == []


def test_pii_links_groups_of_digits():
    def links(text):
        graph = pii.Graph()
        graph.add(0, text, [])
        return {(text[graph.start[a] : graph.end[a]], text[graph.start[b] : graph.end[b]]) for a, b in graph.skip if a < b}

    assert {("+44", "20"), ("+44", "020")}.isdisjoint(links("on +44 20 7946 0958 or 020 7946 0958"))
    assert {("20", "020"), ("7946", "7946"), ("0958", "0958")} <= links("on +44 20 7946 0958 or 020 7946 0958")
    assert {("4111", "4111"), ("2222", "2222"), ("3333", "3333"), ("4444", "4444")} <= links("4111 2222 3333 4444 then 4111 2222 3333 4444")
    assert {("4111222233334444", x) for x in ("4111", "2222", "3333", "4444")} <= links("4111222233334444 then 4111 2222 3333 4444")
    assert not links("12 34 then 12 35")


def test_pii_messages_settle():
    """A label held at one end of a chain of 60 links reaches the other end, as exact sums over the chain have it."""
    graph = pii.Graph()
    graph.add(0, " x ".join(["12345678"] * 61), [(2, 0, 8)])
    near = np.full((pii._LABELS, pii._LABELS), -2.0) + np.diag([2.0] * pii._LABELS)
    weights = np.zeros((pii.HASHED, pii._LABELS))
    got = pii.marginals(graph, weights, near, near)
    step = np.exp(3 * near)  # the tokens share three keys
    belief = np.eye(pii._LABELS)[graph.label[0]]
    for _ in range(60):
        belief = belief @ step
    assert np.allclose(got[-1], belief / belief.sum(), atol=1e-3) and got[-1, 3] > 0.5


def test_pii_rows(spark, corpus):
    docs, rows = corpus
    found = pii.personal_data(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        listed = [x for x in r.spans.split(",") if x]
        assert len(listed) >= r.n_email + r.n_ip + r.n_card + r.n_phone
    odd = next(r for r in found if r.doc_id == -8)
    assert (odd.n_email, odd.n_ip, odd.n_card, odd.n_phone) == (3, 1, 0, 1)  # the card reads on from the address before it
    assert pii.redacted_rows(docs).columns == docs.columns


def test_rule_statistics(spark, corpus):
    docs, rows = corpus
    want = Counter()
    for d, t in rows:
        t = t or ""
        words, places = WORDS.findall(t), {}
        for i in range(len(words) - 7):
            places.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {k for p in places.values() if len(p) > 1 for i in p for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        want[d, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)] += 1
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter(map(tuple, rules.statistics(docs).select(*names).collect())) == want


def test_rules_find_a_planted_rule(spark, corpus):
    rows = [(k, "word " * (30 + k % 7) + ("# " * 9 if k % 5 == 0 else ""), int(k % 5 != 0)) for k in range(600)]
    rows = [(k, " ".join(f"{w}{i}" for i, w in enumerate(t.split())), y) for k, t, y in rows]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, quality int")
    found = {r.doc_id: r.kept for r in rules.quality_rules(docs, labels).collect()}
    assert all(found[k] == bool(y) for k, _, y in rows)
    assert all(r.kept for r in rules.quality_rules(docs, labels.limit(0)).collect())


def test_rules_find_rare_junk(spark, corpus):
    """Junk in one row of eighty, by more symbols than the one to three of every second clean row."""
    random = np.random.default_rng(4)
    rows = []
    for k in range(2400):
        words = ["".join(x) for x in random.choice(list("abcdefgh"), (random.integers(40, 60), 5))]
        for i in range(20 if k % 80 == 0 else random.integers(1, 4) * (k % 2)):
            words[i] = "#" + words[i][1:]
        rows.append((k, words, int(k % 80 != 0)))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id bigint, quality int")
    found = {r.doc_id: r.kept for r in rules.quality_rules(docs, labels).collect()}
    assert all(found[k] == bool(y) for k, _, y in rows)


@pytest.mark.parametrize("name,label,module", [("toxic", "toxic", toxicity.toxicity), ("quality", "quality", quality.quality)])
def test_classifiers(spark, corpus, name, label, module):
    docs, rows = corpus
    big = common.read_table(spark, "/root/testdata/sf0.01", "documents").withColumn("score", F.lit("clash"))
    labels = common.read_table(spark, "/root/testdata/sf0.01", "labels")
    found = module(big, labels, common.crc_mod("doc_id", 5) == 0).join(labels, "doc_id").filter("held_out").collect()
    score, y = np.array([r.score for r in found]), np.array([r[label] for r in found])
    above = (score[y == 1][:, None] > score[y == 0][None]).mean()
    assert above > 0.8 and ((score >= 0) & (score <= 1)).all()
    none = module(docs, labels.limit(0), common.crc_mod("doc_id", 5) == 0).collect()
    assert len(none) == len(rows) and len({r.score for r in none}) == 1
    assert module(empty(spark), labels, common.crc_mod("doc_id", 5) == 0).count() == 0


@pytest.mark.parametrize("kind", ["phrases of ordinary words", "rare insults"])
def test_toxicity_without_frequent_words(kind):
    """Toxic by the order of ordinary words, or by words that are in 1 % of the toxic texts."""
    random = np.random.default_rng(8)
    words = ["".join(x) for x in random.choice(list("abcdefgh"), (300, 6))]
    phrases = [" ".join(random.choice(words, 5)) for _ in range(6)]
    insults = ["".join(x) for x in random.choice(list("klmnopqrst"), (300, 9))]

    def text(toxic):
        out = list(random.choice(words, 60))
        for at in random.choice(12, 3, replace=False) if toxic else ():
            out[5 * at : 5 * at + 5] = random.choice(phrases).split() if kind.startswith("phrases") else [random.choice(insults), *out[5 * at + 1 : 5 * at + 5]]
        return " ".join(out)

    rows = [(k, int(k % 5 < 2), text(k % 5 < 2)) for k in range(1500)]
    if kind == "rare insults":
        seen = Counter(w for _, y, t in rows[:1000:2] if y for w in set(t.split()) & set(insults))
        assert len(seen) > 200 and np.mean(list(seen.values())) < 0.02 * 200
    *raw, weights = toxicity.fit(rows[:1000])
    made = toxicity.Difference(*raw)
    score = np.array([made.features(t.encode()) @ weights[:-1] + weights[-1] for _, _, t in rows[1000:]])
    y = np.array([y for _, y, _ in rows[1000:]])
    assert (score[y == 1][:, None] > score[y == 0][None]).mean() > 0.9


def test_mixing_meets_targets(spark, corpus):
    random = np.random.default_rng(2)
    p = random.dirichlet([0.3, 0.3, 0.3], 400)
    n = random.integers(1, 500, 400)
    found = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "n_tokens bigint, p array<double>")
    targets = [0.6, 0.3, 0.1]
    steps, size, left = mixing.fitted_steps(found, targets)
    rows = found.withColumn("rate", mixing.state_of(steps, size)["r"]).collect()
    rate = np.array([r.rate for r in rows])
    tokens, q = np.array([r.n_tokens for r in rows]), np.array([r.p for r in rows])
    assert rate.min() >= 0 and np.abs((rate * tokens) @ q / tokens.sum() - targets).max() < 2e-3
    assert np.allclose((rate * tokens) @ q / tokens.sum() + left, targets)


def test_pipeline_stages(spark, corpus):
    import corpus_pipeline

    docs = common.read_table(spark, SF, "documents")
    before = docs.count()
    for _, function in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(function(spark, docs, SF), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert 0 < docs.count() <= 2 * before
    assert set(QUERIES) == {q for q in QUERIES if re.match(r"op\d+_", q)} and len(QUERIES) == 13


def flat_rates(p, tokens, targets, low, high, steps=20000):
    """Dense projected gradient over one rate per row."""
    p, tokens = np.array(p, float), np.array(tokens, float)
    n = tokens.sum()
    share = np.maximum((tokens[:, None] * p).sum(0) / n, 1e-6)
    wanted = np.array(targets, float) / sum(targets)
    gram = (tokens[:, None, None] * p[:, :, None] * p[:, None, :]).sum(0) / n
    step = 1 / (np.linalg.eigvalsh(gram / np.sqrt(np.outer(share, share)))[-1] + mixing.PULL)
    rate = np.ones(len(p))
    for _ in range(steps):
        totals = (tokens[:, None] * rate[:, None] * p).sum(0) / n
        rate = np.clip(rate - step * (p @ ((totals - wanted) / share) + mixing.PULL * (rate - 1)), low, high)
    return rate


@pytest.mark.parametrize("keep", [None, 0])
def test_mixing_rates_are_those_of_dense_projected_gradient(spark, corpus, keep):
    labels = common.read_table(spark, SF, "labels")
    targets = [0.7, 0.1, 0.15, 0.05]
    found = mixing.mixing_rates(corpus[0], labels, mixing.label_domain(), targets, F.lit(True), keep=keep).collect()
    assert len(found) == corpus[0].count()
    p, tokens = np.array([r.p for r in found]), np.array([r.n_tokens for r in found])
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(p * mixing.PARTS, np.rint(p * mixing.PARTS))
    clean = p.argmax(axis=1) == 0
    low, high = (0, np.inf) if keep is None else (np.where(clean, 1, 0), np.where(clean, np.inf, 1))
    want = flat_rates(p, tokens, targets, low, high)
    rate = np.array([r.rate for r in found])
    totals = lambda r: (tokens[:, None] * r[:, None] * p).sum(0) / tokens.sum()
    assert np.abs(totals(rate) - totals(want)).max() < 2e-3
    assert found[0].residual == pytest.approx(np.abs(totals(rate) - targets).max(), abs=1e-6)
    assert (rate >= low).all() and (rate <= high).all()
    assert all(r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in found)


def test_mixing_without_rows_labels_or_free_names(spark, corpus):
    labels = common.read_table(spark, SF, "labels")
    make = lambda docs, known: mixing.mixing_rates(docs, known, mixing.label_domain(), [0.5, 0.5, 0, 0], F.lit(True))
    assert make(empty(spark), labels).count() == 0
    assert {r.residual for r in make(corpus[0], labels.limit(0)).collect()} != set()
    names = {n: F.lit(n) for n in ("chance", "p", "n_tokens", "copy", "copies", "row", "rate", "residual", "odd name.")}
    mixed = mixing.mixed_rows(corpus[0].withColumns(names), labels, mixing.label_domain(), [0.96, 0.04, 0, 0], F.lit(True), keep=0)
    rows = mixed.collect()
    assert mixed.columns == corpus[0].withColumns(names).columns and {r.chance for r in rows} == {"chance"}
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert max(Counter(r.doc_id for r in rows if r.doc_id in toxic).values(), default=0) <= 1


def test_pii_links_carry_labels_and_nothing_else(spark):
    """A mention that the pattern misses hears of its labelled twin, however far; numbers that only repeat each other do not."""
    model = np.zeros((pii.HASHED, len(pii.KINDS) + 1)), np.zeros((5, 5)), 4 * np.eye(5)
    card, other = "4845168114407329", "4845168114407321"
    assert pii._luhn(card) and not pii._luhn("12" + card) and not pii._luhn(other)
    filler = "word 7 " * 300
    text = f"card {card} paid {filler} order 12 {card} again"
    (base, every), (_, none) = pii.find([text, f"card {other} paid {filler} order 12 {other} again, {other}"], model)
    start = text.rindex(card)
    assert base == [(2, 5, 21)] and every == [(2, 5, 21), (2, start, start + 16)] and none == []

    random = np.random.default_rng(6)
    bad = [x for x in ("4" + "".join(map(str, random.integers(0, 10, 15))) for _ in range(900)) if not pii._luhn(x) and not pii._luhn("12" + x)][:200]
    rows = [(k, f"number {x} paid; order 12 {x} and again {x}; card {card}") for k, x in enumerate(bad)]
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.spans for r in found} == {f"card:{len(rows[0][1]) - 16}:{len(rows[0][1])}"}


def test_pii_long_words_take_linear_time():
    from time import perf_counter

    text = "x" * 1_000_000 + " 5 " + "y" * 1_000_000 + "@"
    start = perf_counter()
    assert [e - s for s, e in pii._tokens(text)] == [1, 1_000_001]
    assert perf_counter() - start < 2
    words = "a 1b é2 3 x@y ..4\n5"
    assert [words[s:e] for s, e in pii._tokens(words)] == [m.group() for m in re.finditer(r"\S*[0-9@]\S*", words)]


def test_a_repeated_id_sends_one_row_to_the_sample(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, None)] + [(3, f"t{k:04}") for k in range(3000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert labelled.labelled_sample(docs, labels, "quality", F.lit(True), 10) == [(1, 1, "a"), (2, 0, None), (3, 0, "t0000")]
    assert mixing.labelled_domains(docs, labels, mixing.label_domain(), F.lit(True), 10, 4) == [(0, "a"), (3, ""), (2, "t0000")]
