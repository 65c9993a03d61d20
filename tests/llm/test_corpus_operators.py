"""Each operator against a brute-force version, over odd rows: nulls, empty and long texts, ties, repeated rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from windrow.llm import components, factorisation_machine, image_copies, line_templates, mixing, packing, personal_data, quality_rules, queries, repeats, simhash, suffix_array, suffix_tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def invented(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    vocab = ["".join(r.choice(("an", "the", "re", "sch", "é", "ñ", "ou")) for _ in range(r.randint(1, 4))) for _ in range(400)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, texts = line(60), [None, "", " \n\t ", "x", "ß 7"]
    for i in range(40):
        texts.append("\n".join([line(r.randint(4, 50)) for _ in range(r.randint(1, 4))] + ["All rights reserved 20%02d." % i] * (i % 3 == 0)))
    texts += [texts[7], texts[7], texts[7].replace("the", "tha", 1), line(20) + " " + shared + " " + line(9), line(5) + " " + shared, "ab " * 120, line(3000)]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(invented(), SCHEMA)


def split(t):
    return (t or "").encode().split()


LIMITS = [{}, {"split": 1}, {"piece": 150}, {"split": 1, "piece": 150}]


def crowded() -> list[tuple]:
    """One passage in many documents, with different texts around it: its edges are anchors that very many stretches share."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(50))
    return [(1000 + i, " ".join([word() for _ in range(30)] + [passage] + [word() for _ in range(30)]), "en", "s", 1) for i in range(60)]


@pytest.mark.parametrize("limits", LIMITS)
def test_suffix_array(spark, limits, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 0.01)
    rows, seen, want = invented() + crowded(), set(), {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i] = (len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = suffix_array.without_earlier_copies(docs, **limits)
    assert {r.doc_id: (r.n_units, r.n_removed, len(r.spans), sha(r.kept)) for r in got.collect()} == want
    assert suffix_array.without_earlier_copies(docs.limit(0)).count() == 0


def test_hot_anchors_are_found(spark):
    docs = spark.createDataFrame(crowded(), SCHEMA).select(F.col("doc_id").alias("uid"), "text")
    assert len(repeats.hot_anchors(docs, repeats.Units("bytes", 100, 24, True, split=20), 0.001)) > 1
    assert len(repeats.hot_anchors(docs, repeats.Units("bytes", 100, 24, True, split=10**6), 0.001)) == 0


def naive_common(a: bytes, b: bytes, most: int) -> int:
    return next((i for i in range(most) if a[i : i + 1] != b[i : i + 1] or i >= min(len(a), len(b))), most)


@pytest.mark.parametrize("depth", [3, 9, 20, 100])
def test_factors_and_nodes_against_plain_versions(depth):
    r = random.Random(depth)
    text = bytes(r.choice(b"ab") for _ in range(300)) + b"abcabcabd" * 20
    text += text[40:260]
    n = len(text) - depth
    levels = repeats.suffix_ranks(np.frombuffer(text, np.uint8), depth)
    at = np.arange(n)
    order = np.lexsort((at, levels[-1][1][:n]))
    assert [text[i : i + depth] for i in order] == sorted(text[i : i + depth] for i in range(n))
    lcp = np.zeros(n, np.int64)
    lcp[1:] = repeats.common_prefixes(levels, order[:-1], order[1:], depth)
    assert lcp[1:].tolist() == [naive_common(text[a:], text[b:], depth) for a, b in zip(order[:-1], order[1:], strict=True)]
    factors = suffix_array.longest_previous_factors(order, lcp)
    assert all(f == max((naive_common(text[i:], text[j:], depth) for j in range(i)), default=0) for i, f in zip(order, factors, strict=True))
    nodes = suffix_tree.internal_nodes(lcp)
    want = set()
    for i in range(1, n):
        if lcp[i]:
            a = next(x for x in range(i, -1, -1) if lcp[x] < lcp[i])
            b = next((x for x in range(i, n) if lcp[x] < lcp[i]), n)
            want.add((int(lcp[i]), a, b - 1))
    assert set(zip(nodes.depth.tolist(), nodes.first.tolist(), nodes.last.tolist(), strict=True)) == want


def test_suffix_order_of_groups():
    texts = [b"banana-bandana-banana", b"xbanana-band"]
    units = np.frombuffer(b"".join(texts), np.uint8)
    for depth in (1, 3, 5, 9, 12):
        rank = repeats.suffix_ranks(units, depth)[-1][1]
        whole = units.tobytes()
        for i in range(len(whole) - depth):
            for j in range(len(whole) - depth):
                assert (rank[i] < rank[j]) == (whole[i : i + depth] < whole[j : j + depth])


def test_repeated_ids_and_nulls(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, long), (None, long), (None, None), (2, "")]
    got = suffix_array.without_earlier_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (0, len(long)), (1, 0), (1, len(long)), (2, 0)]
    tree = suffix_tree.without_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in tree) == [(0, 0), (0, 50), (1, 50), (1, 50), (2, 0)]


@pytest.mark.parametrize("limits", LIMITS)
def test_suffix_tree(spark, limits, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 0.01)
    rows, count, want = invented() + crowded(), Counter(), {}
    for _, t, *_ in rows:
        w = split(t)
        count.update(tuple(w[s : s + 35]) for s in range(len(w) - 34))
    for i, t, *_ in rows:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - 34):
            if count[tuple(w[s : s + 35])] > 1:
                gone[s : s + 35] = True
        want[i] = (len(w), int(gone.sum()), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    got = suffix_tree.without_repeated_passages(spark.createDataFrame(rows, SCHEMA), **limits)
    assert {r.doc_id: (r.n_units, r.n_removed, sha(r.kept)) for r in got.collect()} == want


@pytest.mark.parametrize("kind", ["bytes", "words"])
def test_texts_of_over_two_to_the_24_units(kind):
    chance = np.random.default_rng(1)
    n = (1 << 24) + 5000
    if kind == "bytes":
        long, u = chance.integers(97, 123, n, np.uint8).tobytes().decode(), repeats.Units("bytes", 100, 24, True)
        passage = long[-300:]
    else:
        vocab = [f"w{i}" for i in range(3000)]
        own = chance.integers(0, 3000, n)
        long, u = " ".join([vocab[i] for i in own.tolist()]), repeats.Units("words", 35, 10, False)
        passage = " ".join(vocab[i] for i in own[-120:].tolist())
    row, lo, _, a, _ = repeats.stretches(*u.of(pa.array([long, passage], pa.large_string()))[:2], u)
    assert set(a[row == 1].tolist()) <= set(a[row == 0].tolist()) and lo[row == 0].max() > 1 << 24


def fingerprint(t: str | None, size: int = 4) -> int:
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs):
    rows = [*invented(), (None, "x y z", "en", "s", 5)]
    prints = {i: fingerprint(t) for i, t, *_ in rows}
    root = {i: i for i in prints if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in root:
        for j in root:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: find(i) for i in root}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_fingerprint_links_against_all_pairs(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = {b for b in base} | {b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 7))) for b in base for _ in range(25)}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = simhash.fingerprint_components(spark.createDataFrame([(signed(f), 1) for f in fps], "fp long, n long"))
    groups, want = defaultdict(set), defaultdict(set)
    for x in got.collect():
        groups[x.root].add(x.fp)
    for f in fps:
        want[find(f)].add(signed(f))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 130)}


def test_words_of_known_parts_need_no_tokenizer():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    r = random.Random(8)
    odd = ["don't", "İx", "ΑΣ", "ΑΣ,", "e\u0301t", "<|endoftext|>", "a1b,", "...", ",", "it's.", "x'", "ª", "µ.", "ÀÿßÉ!?", "Ǆ", "中文,", "word\u0301.", "a\u00a0b", "x" * 3000]
    odd += ["".join(r.choice("abÉßyZ.,;1'é#\u0301-") for _ in range(r.randint(1, 9))) for _ in range(4000)]
    vocab = list(dict.fromkeys([*odd, "Strangely", "x."]))
    for part in (vocab, vocab[::-1]):
        ids, starts, sizes = packing._ids(part, path)
        assert [ids[a : a + n].tolist() for a, n in zip(starts, sizes, strict=True)] == [plain.encode(w, add_special_tokens=False).ids for w in part]
    kept = packing._known[path].tokenizer
    packing._known[path].tokenizer = SimpleNamespace(encode_batch_fast=lambda strings, **_: [1 / 0 for _ in strings])
    try:
        ids, starts, sizes = packing._ids(["STRANGELY.", "strangely"], path)
    finally:
        packing._known[path].tokenizer = kept
    assert ids[starts[0] : starts[0] + sizes[0]].tolist() == plain.encode("strangely.", add_special_tokens=False).ids


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    rows = [*invented(), (900, "don't <|endoftext|> É́ x ﬁ 12 a\x0bb", "", "", 0), (None, "y", "", "", 0)]
    pieces = packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x, *_ in rows}
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    assert set(by) == set(ids)
    for i, own in by.items():
        own.sort(key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]
        assert sum(p.length for p in own) == len(ids[i]) and {p.doc_tokens for p in own} == {len(ids[i])}
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][p.start : p.start + p.length], "<u4").tobytes())
    sequences, padding = defaultdict(list), 0
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        size = sum(p.length for p in own)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1].tolist()] and size <= 2048
        padding += 0 if size & (size - 1) == 0 else 2048 - size
    assert padding < 0.01 * sum(map(len, ids.values()))
    assert packing.packed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_quality_rules(spark, docs):
    rows = [(i, "re an the sch on it " * 3 + f"w{i} x{i} y{i} z{i} u{i} v{i} q{i}", "", "", 0) for i in range(60)]
    rows += [(100 + i, " ".join(f"{c}{i}###" for c in "abcdefghijklmnopqrstuvwxy"), "", "", 0) for i in range(6)]
    rows += [(200, None, "", "", 0), (201, "a b\na b\n\nc #%", "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality_rules.quality(df, spark.createDataFrame([(i,) for i in range(40)], "doc_id long")).collect()}
    assert (got[201].n_words, got[201].word_chars, got[201].n_symbols, got[201].n_dup_lines) == (6, 7, 2, 1)
    assert got[200].n_words == 0 and got[200].base_failed and not got[200].kept
    assert all(got[i].kept == (not got[i].base_failed) for i in range(60)) and not any(got[100 + i].kept for i in range(6))
    repeat = {}
    for i, t, *_ in invented():
        w = split(t)
        windows = Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
        inside = {k for s in range(len(w) - 7) if windows[tuple(w[s : s + 8])] > 1 for k in range(s, s + 8)}
        repeat[i] = len(inside)
    assert {r.doc_id: r.n_repeat_words for r in quality_rules.quality(docs, docs.select("doc_id")).collect()} == repeat
    kept = quality_rules.accepted(df, spark.createDataFrame([(i,) for i in range(40)], "doc_id long"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twins(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.sql(queries.oracle_sql()[name]).df().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns].astype(got.dtypes.to_dict()))


def test_mixing_meets_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(0, 40), "", r.choice(("a", "b", "b", "b", "c", None)), 0) for i in range(900)]
    out = mixing.mix(mixing.sizes(spark.createDataFrame([*rows, (950, None, "", "a", 0)], SCHEMA))).collect()
    taken, target = Counter(), {}
    for x in out:
        taken[x.source] += x.copies * x["size"]
        target[x.source] = (x.target, x.source_size)
        assert 0 <= x.copies <= 3
    total = sum(x["size"] for x in out)
    assert abs(sum(t for t, _ in target.values()) - total) < 1
    assert all(abs(taken[s] - t) <= 40 and t <= 3 * n + 1e-6 for s, (t, n) in target.items())
    assert mixing.mix(mixing.sizes(spark.createDataFrame([], SCHEMA))).count() == 0


def test_line_templates(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"{word()} {word()}\nServed from node {i} at once today friends\n{word()} {word()} {word()}", "", "", 0) for i in range(30)]
    copy = "\n".join(f"{word()} {word()} {word()}" for _ in range(5))
    rows += [(100 + i, copy, "", "", 0) for i in range(20)] + [(200, None, "", "", 0), (201, "", "", "", 0)]
    got = {x.doc_id: x for x in line_templates.without_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 and "Served" not in got[i].kept_text for i in range(1, 30))
    assert all(got[100 + i].n_dropped == 0 for i in range(20))  # a copied document is not a template
    assert got[200].kept_text is None and got[201].kept_text == "" and got[200].n_lines == 0


def test_a_leaf_learns_several_line_templates(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    around = lambda line: f"{word()} {word()}\n{line}\n{word()} {word()} {word()}"
    forms = ("we at home {} one two three four", "we at home five six {} seven eight", "we at home nine ten red {} blue")
    lines = [f.format("fixed") for f in forms for _ in range(3)] + [f.format(word()) for f in forms for _ in range(30)]
    r.shuffle(lines)
    rows = [(i, around(line), "", "", 0) for i, line in enumerate(lines)]
    got = line_templates.without_templates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(x.n_dropped for x in got) == len(lines) - 3  # all three forms recur in one leaf, and one line of each stays


def test_factorisation_machine(spark):
    r = np.random.default_rng(0)
    machine = factorisation_machine.Machine(0.3, r.normal(size=20), r.normal(size=(20, 3)))
    feature, value = np.array([2, 5, 11]), np.array([0.5, 1.0, 2.0])
    pairs = sum(machine.factors[feature[i]] @ machine.factors[feature[j]] * value[i] * value[j] for i in range(3) for j in range(i))
    assert np.isclose(machine.margins(np.zeros(3, int), feature, value, 1)[0], 0.3 + machine.linear[feature] @ value + pairs)
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = factorisation_machine.scored(docs, factorisation_machine.fit(docs, labels)).join(labels, "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.93
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert all(0 <= x.score <= 1 for x in factorisation_machine.scored(odd, machine=factorisation_machine.fit(docs.limit(0), labels)).collect())


def test_personal_data(spark):
    text = "mail a.b@c.example.org, 1.2.3.4 999.1.1.1 +1 (555) 010-9999 x 4111 1111 1111 1111 (212) 555-0187 end"
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "plain words in 2024 only, about 12.50 each")]
    got = personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = next(x for x in got if x.doc_id == 1)
    cut = lambda spans: [(s.kind, text[s.start : s.end]) for s in spans]
    assert cut(first.base) == [("email", "a.b@c.example.org"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]
    assert set(map(tuple, first.base)) <= set(map(tuple, first.spans)) and ("phone", "(212) 555-0187") in cut(first.spans)
    assert all(not x.spans for x in got if x.doc_id in (2, 3, 4)) and len(got) == 5
    model = personal_data.SegmentModel.fitted(personal_data.examples())
    right = total = found = 0
    for t, truth in personal_data.examples(150, seed=77):
        own = set(model.spans(t))
        right, total, found = right + len(own & set(truth)), total + len(truth), found + len(own)
    assert right / total > 0.9 and right / found > 0.9


def test_image_copies(spark):
    pages = [(i, f"http://h{i}", f"<h1>title {i % 12}</h1>") for i in range(40)]
    images = image_copies.page_images(spark.createDataFrame(pages, "page_id long, url string, html string"))
    odd = spark.createDataFrame([(90, b"not an image"), (91, b"not an image"), (92, None), (93, None)], "image_id long, image binary")
    got = {r.image_id: r.class_id for r in image_copies.copies(images.unionByName(odd)).collect()}
    assert got == {i: i % 12 for i in range(40)} | {90: 90, 91: 90, 92: 92, 93: 93}


def edited(a: np.ndarray) -> dict[str, np.ndarray]:
    """Copies of a picture as they are made in practice."""
    small = image_copies._scaled(a, 0.75)
    return {
        "same": a,
        "crop": a[10:62, 6:70],
        "light": np.clip(a * 0.85 + 20, 0, 255),
        "resized to 0.75": small,
        "quarter turn": np.rot90(a),
        "half turn, cropped": np.rot90(a, 2)[4:, 4:],
        "resized to 0.56": image_copies._scaled(a, 0.5625),
        "coarse": np.rint(a / 16) * 16,
    }


def pgm(a: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % a.shape[::-1] + np.clip(np.rint(a), 0, 255).astype(np.uint8).tobytes()


def test_edited_copies_of_images_against_all_pairs(spark):
    rows, source = [], []
    for i in range(25):
        for kind, a in edited(image_copies.picture(f"picture {i}")).items():
            rows.append((len(rows), pgm(a)))
            source.append((i, kind))
    got = {r.image_id: r.class_id for r in image_copies.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    classes = defaultdict(set)
    for i, c in got.items():
        classes[c].add(source[i][0])
    assert all(len(x) == 1 for x in classes.values())  # different pictures never meet
    found = [got[i] == got[i - i % 8] for i in range(len(rows)) if i % 8]
    assert sum(found) / len(found) >= 0.9, Counter(source[i][1] for i in range(len(rows)) if got[i] != got[i - i % 8])
    assert len({got[8 * i] for i in range(25)}) == 25


def test_matches_are_counted_before_they_vote(spark):
    most = image_copies.CONSENSUS
    rows = [(1, 2, k, k) for k in range(most)] + [(1, 3, k % (most - 1), 0) for k in range(40)]  # a pair's match in four tables is one
    got = image_copies._enough(spark.createDataFrame(rows, "a long, b long, ap long, bp long")).collect()
    assert sorted(map(tuple, got)) == rows[:most]


def test_blocks_link_what_all_matches_agree_on(spark):
    turned = lambda i, k: np.rot90(image_copies.picture(f"picture {i}"), k)[k:, 2 * k :]
    images = [turned(i, k) for i in range(30) for k in range(3)] + [image_copies._scaled(turned(i, 1), 0.75) for i in range(10)]
    images = [np.rint(a) for a in images] + [np.tile(image_copies.picture("tile")[:20, :20], (4, 4))] * 2  # corners of equal words in one image
    p, d = zip(*[image_copies.descriptors(a[None])[1:] for a in images], strict=True)
    rows = []
    for b in range(len(images)):
        for a in range(b):
            bits = np.bitwise_count((d[a][:, None] ^ d[b][None]).view(np.uint64)).sum(2)
            words = d[a].view(np.uint32)[:, None] == d[b].view(np.uint32)[None]
            rows += [(a, b, int(p[a][x]), int(p[b][y])) for x, y in zip(*np.nonzero((bits <= image_copies.MATCH) & words.any(2)), strict=True)]
    want = {(r.a, r.b) for r in image_copies._agreed(spark.createDataFrame(rows, "a long, b long, ap long, bp long")).collect()}

    def block(lo, hi):
        flat = [np.concatenate(x).tobytes() for x in (p[lo:hi], [x[:, 0] for x in d[lo:hi]], [x[:, 1] for x in d[lo:hi]])]
        return image_copies.Block(np.arange(lo, hi).tobytes(), np.array([len(x) for x in p[lo:hi]], np.int32).tobytes(), *flat)

    ends = [0, 1, 40, len(images)]
    blocks = [block(lo, hi) for lo, hi in zip(ends, ends[1:], strict=False)]
    got = Counter((int(a.ids[x]), int(b.ids[y])) for i, a in enumerate(blocks) for b in blocks[i:] for x, y in zip(*image_copies.linked(a, b), strict=True))
    assert set(got) == want and set(got.values()) == {1} and len(want) > 80
    few = pytest.MonkeyPatch()
    few.setattr(image_copies, "MATCHES", 50)
    few.setattr(image_copies, "SLOTS", 4)
    one = block(0, len(images))
    assert set(zip(*(x.tolist() for x in image_copies.linked(one, one)), strict=True)) == want
    few.undo()


def test_few_corners_that_share_words_are_compared(spark, monkeypatch):
    """Links are those that all matches vote for, whatever turns they have, but of corners that share words only those are compared
    that CONSENSUS others agree with on scale and turn."""
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, (40, 2))
    sizes = r.integers(12, 30, 60)
    p, d = [], []
    for n in sizes:
        turn, (x, y) = r.integers(0, 256, n), r.integers(-160, 160, (2, n)) + image_copies.HALF
        p.append(r.integers(0, 3, n) << 48 | turn << 40 | x << 20 | y)
        d.append(base[np.minimum(r.zipf(1.4, n) - 1, 39)] ^ np.where(r.random((n, 2)) < 0.3, 1 << r.integers(0, 63, (n, 2)), 0))
    for k in range(1, 30):  # copies of the first picture, turned and moved, in part
        some = r.permutation(sizes[0])[: sizes[k]]
        to, moved = 9 * k, np.exp(2j * np.pi * 9 * k / 256)
        at = ((p[0] >> 20 & (1 << 20) - 1) - image_copies.HALF + 1j * ((p[0] & (1 << 20) - 1) - image_copies.HALF))[some] * moved + 3 * k
        p[k][: len(some)] = (p[0][some] >> 48 << 48) | ((p[0][some] >> 40 & 255) + to & 255) << 40 | (np.rint(at.real).astype(int) + image_copies.HALF) << 20 | np.rint(at.imag).astype(int) + image_copies.HALF
        d[k][: len(some)] = d[0][some]
    rows = []
    for b in range(len(sizes)):
        for a in range(b):
            bits = np.bitwise_count((d[a][:, None] ^ d[b][None]).view(np.uint64)).sum(2)
            words = d[a].view(np.uint32)[:, None] == d[b].view(np.uint32)[None]
            rows += [(a, b, int(p[a][x]), int(p[b][y])) for x, y in zip(*np.nonzero((bits <= image_copies.MATCH) & words.any(2)), strict=True)]
    want = {(x.a, x.b) for x in image_copies._agreed(spark.createDataFrame(rows, "a long, b long, ap long, bp long")).collect()}
    flat = [np.concatenate(x).tobytes() for x in (p, [x[:, 0] for x in d], [x[:, 1] for x in d])]
    block = image_copies.Block(np.arange(len(sizes)).tobytes(), sizes.astype(np.int32).tobytes(), *flat)
    compared, near = [], image_copies._near
    monkeypatch.setattr(image_copies, "_near", lambda a, b, ca, cb, t: compared.append(len(ca)) or near(a, b, ca, cb, t))
    links = lambda: set(zip(*(x.tolist() for x in image_copies.linked(block, block)), strict=True))
    assert links() == want and len(want) > 100
    monkeypatch.setattr(image_copies, "MANY", 4)
    monkeypatch.setattr(image_copies, "MATCHES", 20_000)
    assert links() == want
    compared.clear()
    images = [np.rint(image_copies.picture(f"picture {i}")) for i in range(60)]
    _, places, words = zip(*[image_copies.descriptors(a[None]) for a in images], strict=True)
    half = lambda lo: image_copies.Block(np.arange(lo, lo + 30).tobytes(), np.array([len(x) for x in places[lo : lo + 30]], np.int32).tobytes(), *[np.concatenate(x).tobytes() for x in (places[lo : lo + 30], [x[:, 0] for x in words[lo : lo + 30]], [x[:, 1] for x in words[lo : lo + 30]])])
    a, b = half(0), half(30)
    met = sum(int((x[:, None] == y[None]).sum()) for x, y in zip(a.words, b.words, strict=True))
    image_copies.linked(a, b)
    assert 10 * sum(compared) < met and met > 3000


def test_matches_of_images_are_not_dealt(spark):
    """Different pictures share most of their words, so their matches grow with the square of the pictures."""
    pages = [(i, f"http://h{i}", f"<h1>title {i}</h1>") for i in range(300)]
    images = image_copies.page_images(spark.createDataFrame(pages, "page_id long, url string, html string"))
    dealt = lambda: sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0)])
    before = dealt()
    got = image_copies.copies(images).collect()
    assert all(r.class_id == r.image_id and not r.n_links for r in got) and len(got) == 300
    assert dealt() - before < 300 * 3000


def test_links_of_a_task_are_merged():
    rows = [(np.array([5, 3, 9]), np.array([3, 3, 9]), np.array([1, 1, 0])), (np.array([7, 5]), np.array([5, 5]), np.array([2, 2]))]
    got = list(zip(*(x.tolist() for x in image_copies._merged(rows)), strict=True))
    assert got == [(3, 3, 1), (5, 3, 3), (7, 3, 2), (9, 9, 0)]


def test_links_of_copies_are_counted_whole(spark):
    """Three copies have three links, two of each, and equal contents share theirs."""
    a = image_copies.picture("some picture")
    rows = [(1, pgm(a)), (2, pgm(a[4:, 2:])), (3, pgm(a[:-6, 4:])), (4, pgm(a)), (5, pgm(image_copies.picture("another")))]
    got = image_copies.copies(spark.createDataFrame(rows, "image_id long, image binary")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2), (5, 5, 0)]


def test_pictures_are_described_alike_alone_and_together():
    images = np.stack([image_copies.picture(f"picture {i}") for i in range(5)])
    number, place, words = image_copies.descriptors(images)
    for i in range(5):
        _, p, w = image_copies.descriptors(images[i : i + 1])
        assert (p == place[number == i]).all() and (w == words[number == i]).all() and len(p) >= 20


def test_png():
    import struct

    a = (np.arange(30).reshape(5, 6) * 7).astype(np.uint8)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + b"\0\0\0\0"
    up = np.vstack([a[:1], a[1:] - a[:-1]])
    body = b"".join(bytes([2 if y else 0]) + row.tobytes() for y, row in enumerate(up))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert (image_copies.decode(png) == a).all() and image_copies.decode(b"P5 6 5 255\n" + a.tobytes()).shape == (5, 6)
    assert image_copies.decode(b"\x89PNG\r\n\x1a\nxx") is None


def test_line_templates_tell_lines_with_equal_bytes_of_hash_apart(spark):
    byte = lambda w: xxhash.xxh64_intdigest(w.encode(), 42) & 255
    near = [w for w in (f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(17576)) if byte(w) == byte("gamma")][:5]
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    around = lambda line: f"{word()} {word()}\n{line}\n{word()} {word()} {word()}"
    rows = [(i, around("node alpha beta gamma delta"), "", "", 0) for i in range(30)]
    rows += [(100 + i, around(f"node alpha beta {w} other"), "", "", 0) for i, w in enumerate(near)]
    got = {x.doc_id: x.n_dropped for x in line_templates.without_templates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(near) == 5 and all(got[i] == 1 for i in range(1, 30))
    assert all(got[100 + i] == 0 for i in range(5))


@pytest.mark.parametrize("before", ['{"key":"' + "abcdefgh," * 6 + '","phone":"', "row;" * 15 + "phone;", "数据记录" * 14 + "电话"])
def test_personal_data_without_white_space_before(before):
    model = personal_data.SegmentModel.fitted(personal_data.examples())
    seen = {}
    model_spans = model.spans

    class Spy:
        def spans(self, text):
            seen[text] = True
            return model_spans(text)

    number = "(415) 555-1234"
    spans = personal_data.all_spans(before + number + '" and so on', Spy())[1]
    assert any(number in t for t in seen)
    assert any(kind == "phone" and s <= len(before) + 1 and e >= len(before) + len(number) for kind, s, e in spans)
