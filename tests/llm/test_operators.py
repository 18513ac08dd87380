"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import base64
import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from chronotrack.llm import language_id as L
from chronotrack.llm import license_scan as LS
from chronotrack.llm import lm_score as M
from chronotrack.llm import mixing as X
from chronotrack.llm import sentencepiece_scan as S
from chronotrack.llm import simhash as H
from chronotrack.llm import toxicity as T
from chronotrack.llm import webp as V
from chronotrack.llm._batches import parts
from chronotrack.llm._components import connected_components
from chronotrack.llm._pieces import DEFAULT_MODEL, full, units
from chronotrack.llm.exact_dedup import exact_dedup
from chronotrack.llm.line_dedup import line_dedup
from chronotrack.llm.queries import ORACLES
from tests.llm.conftest import DE, EN, prose, rows


def texts():
    return [r[1] for r in rows()] + ["", "a  b\n\n c▁d 漢字𓀀 \n", " ", "x" * 70]


# --- 1 licence scan


def contained(text):
    w, out = LS.words(text), set()
    for name, t in LS.TEMPLATES:
        q = LS.words(t)
        k = min(5, len(q))
        want = {tuple(q[i : i + k]) for i in range(len(q) - k + 1)}
        own = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        if any(len(want.intersection(own[i : i + len(want)])) / len(want) >= 0.8 for i, s in enumerate(own) if s in want):
            out.add(name)
    return out


def test_license_scan_finds_all_planted():
    rng, scanner, batch = random.Random(4), LS.Scanner(LS.TEMPLATES), []
    for t in texts() * 3:
        w, (_, x) = t.split(), rng.choice(LS.TEMPLATES)
        y, p = x.split(), rng.randrange(len(w) + 1)
        if len(y) > 25:
            y[rng.randrange(len(y))] = "changed"
        batch.append(" ".join(w[:p] + y + w[p:]).encode())
    got = scanner.scan(batch)
    for b, (n, found) in zip(batch, got):
        assert n == len(LS.words(b))
        assert {m["template"] for m in found} == contained(b)


def test_band_count():
    assert LS.bands_for(1.0) == 1
    assert 1 - (1 - 0.3) ** LS.bands_for(0.3) >= LS.RECALL


# --- 2 toxicity


def test_toxicity_held_out():
    rng = random.Random(2)

    def sample(bad):
        w = [rng.choice(EN) for _ in range(rng.randrange(30, 90))]
        if bad:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(("zorgface", "blightwit", "mudgrub")))
        return " ".join(w).encode()

    model = T.fit([(sample(k % 3 == 0), int(k % 3 == 0)) for k in range(600)])
    d = T.Distance(*model)
    bad, good = [d.score(sample(True)) for _ in range(60)], [d.score(sample(False)) for _ in range(60)]
    assert np.mean(np.array(bad) >= 0.3) >= 0.9 and np.mean(np.array(good) >= 0.3) <= 0.05
    assert 0 <= d.score(b"") < 0.3


def test_toxic_dictionary_is_trained_on_what_toxic_text_shares():
    rng = random.Random(9)
    insults, alone = [b"blorgish", b"quaxling", b"vumpire"], [b"%08x" % rng.getrandbits(32) for _ in range(120)]
    text = lambda more: b" ".join(rng.choice(EN).encode() if rng.random() > 0.1 else rng.choice(more) for _ in range(120))
    toxic, ordinary = [text([*insults, a]) for a in alone], [text([b"of"]) for _ in range(400)]
    known = T.known_grams(ordinary)
    assert all(b"blorgish"[:6] not in w for t in ordinary for w in T.strange(t, known))
    plain = T.train_ordinary(ordinary)
    got = T.train_toxic(T.stranger(toxic, known), plain, 512)
    assert got[:4] == plain[:4] == bytes.fromhex("37a430ec") and len(got) <= 512  # both come from the dictionary trainer
    assert all(any(i[k : k + 4] in got for k in range(len(i) - 3)) for i in insults) and sum(a in got for a in alone) < 6
    d = T.Distance(plain, got)
    assert d.gain(b"the of blorgish and quaxling to in that") >= 2 > d.gain(b"the of which and there to in that with they")


# --- 3 SentencePiece


@pytest.fixture(scope="module")
def enc():
    return S.encoder(DEFAULT_MODEL)


def sequential(enc, text):
    s = "".join(map(full, units(text)))
    best, back = enc.forward(s, len(s), [0])
    return enc.trace(s, back, len(s), 0), best[-1]


def test_pieces_round_trip_and_best_score(enc):
    for t, ids in zip(texts(), enc.encode_many(texts())):
        if t:
            want, score = sequential(enc, t)
            assert ids.tolist() == want and enc.score(ids) == score
            assert enc.decode(ids) == t


def test_pieces_equal_library(enc):
    m = pb.ModelProto()
    m.ParseFromString(open(DEFAULT_MODEL, "rb").read())
    m.trainer_spec.model_type = 1  # its unigram rule; runs of spaces get an ordinary low score, as theirs overflows its floats
    for p in m.pieces:
        if p.score < -1e8:
            p.score = -40000
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for w in {w for t in texts()[:60] for w in t.split()}:
        assert library.encode(w) == enc.encode(units(w)).tolist()


def test_transfer_matrices_are_associative(enc):
    for t in texts()[:6] + ["漢" * 30 + "ab" * 40]:
        s = "".join(map(full, units(t)))[:400]
        for size in (16, 37):
            ms = [enc.matrix(a, b) for a, b in S.chunks(s, size, enc.states)]
            left = ms[0]
            for m in ms[1:]:
                left = S.times(left, m)
            right = ms[-1]
            for m in ms[-2::-1]:
                right = S.times(m, right)
            assert (left == right).all() and left[0, 0] == enc.forward(s, len(s), [0])[0][-1]


def test_giant_documents(spark, enc):
    data = [(k, t) for k, t in enumerate([" ".join(texts()), "x" * 700 + " 漢▁\n" * 30, "short"])]
    got = {r.doc_id: r for r in S.encode_documents(spark.createDataFrame(data, "doc_id long, text string"), chunk=300).collect()}
    for k, t in data:
        want, score = sequential(enc, t)
        assert got[k].score == score and enc.decode(np.array(got[k].ids)) == t
        assert enc.score(np.array(got[k].ids)) == score
    assert got[0].ids == sequential(enc, data[0][1])[0]


def test_digests_equal_those_of_the_ids(spark):
    data = [(k, t) for k, t in enumerate([*texts()[:40], " ".join(texts()), "", None])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    one = sorted(map(tuple, S.encode_digests(docs, chunk=900).collect()))
    assert one == sorted(map(tuple, S.digest(S.encode_documents(docs, chunk=900)).collect()))
    assert [r[4] for r in one] == [hashlib.sha256((t or "").encode()).hexdigest() for _, t in data]


def test_parts_bound_what_is_read_at_once():
    long = "word " * 200_000
    b = pa.record_batch([pa.array(range(64)), pa.array([long, None, "a", ""] * 16)], names=["doc_id", "text"])
    got = list(parts(b, 1))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([b])) and all(sum(len(t or "") for t in p.column(1).to_pylist()) <= 2_000_000 for p in got)
    ids = pa.record_batch([pa.array(range(9)), pa.array([[1] * 400_000, None, []] * 3, pa.list_(pa.int32()))], names=["doc_id", "ids"])
    got = list(S._id_parts(ids))
    assert len(got) == 3 and pa.Table.from_batches(got).equals(pa.Table.from_batches([ids]))
    assert list(parts(b.slice(0, 0), 1)) == [] and list(S._id_parts(ids.slice(0, 0))) == []


# --- 4 mixing


def test_one_task_rakes_as_many_do(spark, monkeypatch):
    cells = spark.createDataFrame([(f"s{i % 3}", f"l{i % 5}", f"t{i % 2}", 10 * i + 1) for i in range(30)], "source string, lang string, topic string, tokens long").distinct()
    cells = cells.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    one = X.rake(cells, X.DIMENSIONS, None, 0.3, 6).toPandas()
    monkeypatch.setattr(X, "FEW_CELLS", 0)
    many = X.rake(cells, X.DIMENSIONS, None, 0.3, 6).toPandas()
    a, b = (x.sort_values(list(X.DIMENSIONS)).weight.to_numpy() for x in (one, many))
    assert len(a) == 30 and np.allclose(a, b, rtol=1e-9)


def test_raked_marginals(spark):
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", 100 + 37 * i + 11 * j * k) for i in range(4) for j in range(3) for k in range(2)], "source string, lang string, topic string, tokens long")
    aim = {"source": {f"s{i}": 0.25 for i in range(4)}, "lang": {"l0": 0.2, "l1": 0.3, "l2": 0.5}, "topic": {"t0": 0.5, "t1": 0.5}}
    got = X.rake(cells, X.DIMENSIONS, aim, 0.3, 12).toPandas()
    for d, want in aim.items():
        share = got.groupby(d).weight.sum() / got.weight.sum()
        assert all(abs(share[k] - v) < 1e-3 for k, v in want.items())
    assert got.weight.sum() == pytest.approx(0.3 * got.tokens.sum(), rel=1e-6)


# --- 5 language


def test_forward_is_the_sum_over_all_segmentations():
    p = L.pieces(DEFAULT_MODEL)
    rng = np.random.default_rng(1)
    prob = np.vstack((rng.random((len(p.strings), 2)) / 1000, np.zeros((1, 2))))

    def total(u, j):
        if not u:
            return 1.0
        return sum((prob[k, j] if k >= 0 else L.UNKNOWN) * total(u[n:], j) for n in range(1, min(16, len(u)) + 1) for k in [p.index.get(u[:n], -1)] if k >= 0 or n == 1)

    for u in ("the", "nicht", "\nüber", "", "漢a"):
        want = [math.log(total(full(u), j)) for j in range(2)]
        assert L.forward(p, prob, [u])[0] == pytest.approx(want)
        assert L._long(p, prob, full(u)) == pytest.approx(want)


def test_language_held_out(spark, docs):
    r = L.identify_languages(docs, train=docs.where(~L.held_out(F.col("doc_id"), 5, 0))).collect()
    truth = {x[0]: x[2] for x in rows()} | {12: "en"}  # a copy of 5
    assert all(x.lang_pred == truth[x.doc_id] and x.score > 0.9 for x in r if zlib.crc32(str(x.doc_id).encode()) % 5 == 0)


# --- 6 WebP


def test_known_file():
    assert V.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).tolist() == [[0]]


def test_samples_round_trip():
    rng = np.random.default_rng(1)
    data = [t.encode() for t in texts()] + [bytes(rng.integers(0, 256, 64 * 30, dtype=np.uint8)), b"ab" * 320, b"a long line that repeats itself\n" * 60, bytes(64), bytes(range(256)) * 3]
    for d in data:
        d += bytes(-len(d) % 64 or (0 if d else 64))
        assert V.decode_samples(V.encode_samples(d)) == d


def test_several_images():
    d = bytes(np.random.default_rng(2).integers(97, 110, 64 * 16390, dtype=np.uint8))
    assert V.decode_samples(V.encode_samples(d)) == d


@pytest.mark.parametrize("size, colours", [((1, 1), 2), ((7, 5), 3), ((20, 33), 10), ((16, 16), 400)])
def test_all_transforms(size, colours):
    rng, (h, w) = np.random.default_rng(3), size
    palette = rng.integers(0, 2**32, colours, dtype=np.uint64).astype(np.uint32)
    image = palette[rng.integers(0, colours, size)]
    tiles = lambda b, most: rng.integers(0, most, ((h + (1 << b) - 1) >> b, (w + (1 << b) - 1) >> b)).astype(np.uint32)
    cases = [(), ((V.SUBTRACT_GREEN,),), ((V.PREDICTOR, 2, tiles(2, 14)),), ((V.CROSS_COLOUR, 3, tiles(3, 2**24)),), ((V.PREDICTOR, 3, tiles(3, 14)), (V.CROSS_COLOUR, 2, tiles(2, 2**24)), (V.SUBTRACT_GREEN,))]
    if len(np.unique(image)) <= 256:
        cases.append(((V.PALETTE,),))
    for transforms, cache in itertools.product(cases, (0, 4)):
        assert (V.decode(V.encode_argb(image, transforms, (), cache)) == image).all()


def test_copies_and_cache_meet_the_general_reader():
    image = np.tile(np.arange(40, dtype=np.uint32) * 0x01030507, 30).reshape(30, 40)
    copies = [(40, 400, 40), (440, 760, 440)]
    for cache in (0, 5):
        assert (V.decode(V.encode_argb(image, (), copies, cache)) == image).all()


def test_broken_streams_are_refused():
    m = V.encode_samples(b"some text that is long enough to matter, with words\n".ljust(64, b"\0"))
    for bad in (b"", m[:30], b"RIFX" + m[4:]):
        with pytest.raises(ValueError):
            V.decode(bad)


# --- 7 exact duplicates


def test_exact(spark, docs):
    got = {r.doc_id: r for r in exact_dedup(docs).collect()}
    groups = collections.defaultdict(list)
    for i, t, *_ in rows():
        groups[__import__("re").sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())


# --- 8 language model


def test_codes_are_complete():
    for counts in ([5, 1, 1, 3], [1, 1], list(range(1, 300))):
        c = M.Code(np.array(counts, np.int64))
        assert sum(2.0**-n for n in c.size) == pytest.approx(1)
        assert c.all.max() == sum(counts)


def test_base_scores_and_normalisation(spark, docs):
    rest = L.held_out(F.col("doc_id"), 5, 1)
    got = {r.doc_id: r for r in M.lm_scores(docs, ~rest).collect()}
    c = collections.Counter()
    for i, t, *_ in rows():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update([*M.words(t), M.END])
    n, v = sum(c.values()), len(c)
    for i, t, *_ in rows():
        w = [*M.words(t), M.END]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert got[i].score < 0


def test_decisions_sum_to_one():
    """The probabilities of all symbols after one context add up to 1, with and without learned weights."""
    rng = np.random.default_rng(1)
    code = M.Code(np.array([50, 20, 9, 4, 2], np.int64))
    counts = rng.integers(0, 9, (2, 1 << 8, 2)).astype(np.int32)
    for w in (None, rng.normal(0.4, 0.2, (16, 3)).astype(np.float32)):
        p = M.Predictors(code, counts, 8, w)
        one = [p.static([np.full(1, a, np.uint32) for a in (7, 9)], np.array([s]))[0] for s in range(5)]
        assert np.exp(one).sum() == pytest.approx(1, abs=1e-5)
        line = [p.online([np.full(1, a, np.uint32) for a in (7, 9)], np.array([s]), np.zeros(1, int), np.zeros(1, np.uint8), 1)[0] for s in range(5)]
        assert line == pytest.approx(one, abs=1e-5)


def test_online_mixing_equals_a_loop(monkeypatch):
    """Two texts of several blocks each, with growing blocks, against one decision after the other."""
    monkeypatch.setattr(M, "EARLY", 64)
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "RUN", 50)
    rng = np.random.default_rng(3)
    code = M.Code(np.array([50, 20, 9, 4, 2], np.int64))
    p = M.Predictors(code, rng.integers(0, 9, (2, 1 << 8, 2)).astype(np.int32), 8, rng.normal(0.4, 0.2, (16, 3)).astype(np.float32))
    sizes = [300, 41]
    symbols, lane = rng.integers(0, 5, sum(sizes)), np.repeat([0, 1], sizes)
    place = np.concatenate([np.arange(n) for n in sizes])
    contexts = [rng.integers(0, 6, len(symbols)).astype(np.uint32) for _ in range(2)]
    got = p.online(contexts, symbols, lane, place, 2)
    block = lambda k: k // 16 if k < 64 else 4 + int(math.log(k / 64) * 4)
    for text in (0, 1):
        w, pending, begin = p.weights.astype(float), [], 0
        for i in np.flatnonzero(lane == text).tolist():
            if place[i] and block(place[i]) != block(place[i] - 1):
                for gate, step in pending:
                    w[gate] += step
                pending, begin = [], place[i]
            _, bits, x, gates = p.inputs([c[i : i + 1] for c in contexts], symbols[i : i + 1])
            cost = 0.0
            for d, (bit, gate) in enumerate(zip(bits.tolist(), gates.tolist())):
                v = np.array([float(c[d]) for c in x])
                one = 1 / (1 + math.exp(-float(w[gate] @ v)))
                cost += math.log(one if bit else 1 - one)
                pending.append((gate, M.RATE * 64 / max(64, begin) * (bit - one) * v))
            assert got[i] == pytest.approx(cost, rel=1e-3, abs=1e-4), (text, i, place[i])


def test_phrases_follow_the_words():
    rng = random.Random(5)
    w = [prose(rng, EN, 1).encode() for _ in range(400)]
    keys = np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64)
    last = np.zeros(400, bool)
    last[[149, 399]] = True
    ends, h = M.phrases(keys, last)
    assert ends[-1] == 399 and 149 in ends.tolist() and len(set(h.tolist())) == len(h)
    again, h2 = M.phrases(np.concatenate((keys[:3], keys)), np.concatenate((np.zeros(3, bool), last)))
    assert (again[-len(ends) + 1 :] - 3 == ends[1:]).all() and (h2[-len(ends) + 1 :] == h[1:]).all()


def test_phrase_gains_equal_a_loop(spark):
    rng = random.Random(6)
    data = [(i, i % 5 != 0, [rng.randrange(2, 6) for _ in range(rng.randrange(1, 9))]) for i in range(80)]
    data = [(i, t, ph, [-rng.random() * 5 for _ in ph]) for i, t, ph in data]
    got = {r.row: r.gain for r in M._phrase_gains(spark.createDataFrame(data, "row long, train boolean, phrase array<long>, cost array<float>")).collect()}
    seen = collections.defaultdict(collections.Counter)
    each = [(i, t, c, x, y) for i, t, ph, cost in data for c, x, y in zip([M.FIRST, *ph], ph, cost)]
    for i, t, c, x, _ in each:
        if t:
            seen[c][x] += 1
    met = []
    for i, t, c, x, y in each:
        if seen[c]:
            k, guess = max((k, g) for g, k in seen[c].items())
            n, k, hit = sum(seen[c].values()) - t, k - (t and guess == x), guess == x
            if n > 0 and k > 0:
                met.append((i, t, hit, min(int(math.log2(n)), 5) * 5 + int(k / n * 4), y))
    rate = {g: (sum(m[2] for m in met if m[1] and m[3] == g) + 0.5) / (sum(m[1] for m in met if m[3] == g) + 1) for g in {m[3] for m in met}}
    want = collections.defaultdict(float)
    for i, _, hit, g, y in met:
        want[i] += math.log10(rate[g] + (1 - rate[g]) * 10**y) - y if hit else math.log10(1 - rate[g])
    assert got == pytest.approx(dict(want), rel=1e-4, abs=1e-5)


def test_copies_of_training_texts_cost_less(spark):
    rng = random.Random(8)
    text = lambda: prose(rng, [f"w{k}" for k in range(3000)], 300)
    data = [(i, text()) for i in range(60)]
    data += [(100 + i, data[i][1]) for i in range(20)]
    rest = F.col("doc_id") >= 100
    got = {r.doc_id: r.score for r in M.lm_scores(spark.createDataFrame([*data, (130, text())], "doc_id long, text string"), ~rest).collect()}
    assert min(got[100 + i] for i in range(20)) > 0.2 * got[130], got


# --- 9 SimHash


def brute_print(text):
    w = text.encode().translate(H.LOWER).split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    for t in texts():
        assert H.fingerprint(t.encode()) == brute_print(t)


def test_golay_words_within_two_bits_share_a_key():
    rng = random.Random(1)
    assert len(np.unique(H.golay_index(np.arange(1 << 14)))) <= 4096
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(0, 3)):
            b ^= 1 << bit
        x, y = (set(k[k >= 0]) for k in H.golay_keys(np.array([a, b], np.uint64).view(np.int64)))
        assert x & y


@pytest.mark.parametrize("small", [8, 1])
def test_links_have_the_components_of_all_pairs(spark, small):
    rng = random.Random(5)
    prints = {rng.getrandbits(63) for _ in range(40)}
    for p in list(prints)[:6]:
        for _ in range(25):
            q = p
            for bit in rng.sample(range(63), rng.randrange(1, 4)):
                q ^= 1 << bit
            prints.add(q)
    nodes = list(enumerate(sorted(prints)))
    got = {r.node: r.component for r in connected_components(H.links(spark.createDataFrame(nodes, "node long, fp long"), small)).collect()}
    label = {i: i for i, _ in nodes}
    changed = True
    while changed:
        changed = False
        for (i, a), (j, b) in itertools.combinations(nodes, 2):
            if (a ^ b).bit_count() <= 2 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    assert {i: got.get(i, i) for i, _ in nodes} == label


def test_components_of_a_chain(spark):
    got = {r.node: r.component for r in connected_components(spark.range(60).selectExpr("id + 1 as a", "id as b")).collect()}
    assert set(got.values()) == {0} and len(got) == 61


# --- 10 lines


def test_lines(spark, docs):
    got = {r.doc_id: r for r in line_dedup(docs, min_sites=4).collect()}
    key = lambda x: x.strip(" \t\r")
    sites, holder = collections.defaultdict(set), {}
    for i, t, _, s in rows():
        for x in t.split("\n"):
            if key(x).count(" ") >= 2:
                sites[key(x)].add(s)
                holder[key(x)] = min(i, holder.get(key(x), i))
    assert any(len(v) >= 4 for v in sites.values())
    for i, t, *_ in rows():
        kept = [x for x in t.split("\n") if not (len(sites.get(key(x), ())) >= 4 and holder[key(x)] != i)]
        assert got[i].text == "\n".join(kept) and got[i].n_removed == len(t.split("\n")) - len(kept)


def test_oracles_cover_what_sql_can_say():
    assert set(ORACLES) == {"op4_mixing", "op7_exact_dedup", "op10_line_dedup"}


def test_prose_helper():
    assert len(prose(random.Random(1), DE, 5).split()) == 5
