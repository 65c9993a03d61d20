"""The pipeline's stages against what each is to do, on the smallest tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pyarrow as pa

from windrow.llm import packing, quality_rules
from windrow.llm.common import words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert out.columns == docs.columns, name
        if name != "mixing":
            assert 0 < len(rows) <= before and len({r.doc_id for r in rows}) == len(rows)
        before = len(rows)
        docs = spark.createDataFrame(rows, docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in rows}


def test_near_dedup_finds_every_pair_from_similarity_08_on(spark):
    r, rows = random.Random(5), []
    for base in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(30, 400))]
        for copy in range(4):
            for _ in range(round(copy * r.random() * len(words) / 50)):
                words[r.randrange(len(words))] = f"v{r.randrange(5000)}"
            rows.append((len(rows), " ".join(words), "en", f"s{base % 3}", 1))
    rows += [(len(rows), "a b c", "en", "s0", 1), (len(rows) + 1, "A b  c", "en", "s1", 1), (len(rows) + 2, "a b d", "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sets = []
    for _, t, *_ in rows:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root, low = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            like = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            low += 0.8 <= like < 0.95
            if like >= 0.8 and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = [x if c == y else c for c in root]
    assert low > 10
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, schema), SF)
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(root))


def test_line_dedup_takes_whole_blocks_and_lines_that_are_also_in_copies(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    block = "Licensed under some terms of old\nYou may not use this at all\nSee the text of these terms first\n"
    rows = [(i, f"{word()} {word()} {word()}\n{block}{word()} {word()}", "en", "s0", 1) for i in range(20)]
    rows += [(100 + i, f"shared alone {i % 3}\nHot line in copies and elsewhere too", "en", "s0", 1) for i in range(60)]
    rows += [(200 + i, f"{word()} {word()} {word()}\nHot line in copies and elsewhere too\n{word()}", "en", "s0", 1) for i in range(12)]
    copy = "\n".join(f"{word()} {word()} {word()}" for _ in range(4))
    rows += [(300 + i, copy, "en", "s1", 1) for i in range(20)] + [(400 + i, "one line that is all of it, %s" % ("a" * i), "en", "s1", 1) for i in range(3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    got = {x.doc_id: x.text for x in corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, schema), SF).collect()}
    assert all(line in got[0] for line in block.splitlines())
    assert all(line not in got[i] for i in range(1, 20) for line in block.splitlines())
    assert sum("Hot line" in t for t in got.values()) == 1
    assert all(got[300 + i] == copy for i in range(20))  # whole copies count once


# the whole pipeline against a plain version, stage by stage, without any code of the operators but the hashes they define


def plain_quality(docs, labels):
    def counts(text):
        w = words(pa.array([text], pa.string()))
        return np.bincount(quality_rules.ngram_buckets(w)[0], minlength=quality_rules.BUCKETS).astype(float)

    own = {d: counts(t) for d, t, *_ in docs}
    trusted = {d for d, q, x in labels if q == 1 and x == 0}
    held = {d for d in trusted if zlib.crc32(str(d).encode()) % 5 == 0}
    raw, target = sum(own.values()), sum(own[d] for d in trusted - held if d in own)
    base = (raw + 1) / (raw.sum() + len(raw))
    weight = np.log((target + 100 * base) / (target.sum() + 100)) - np.log(base)
    score = {d: float(weight @ c) / max(1, c.sum()) for d, c in own.items()}
    known = sorted(round((min(max(score[d], -12.0), 12.0) + 12.0) / 0.005) * 0.005 - 12.0 for d in held if d in own)
    at = lambda q: known[next(i for i in range(len(known)) if i + 1 >= q * len(known))]
    least = at(0.25) - max(0.1, 3 * (at(0.75) - at(0.25)))
    out = []
    for row in docs:
        w = (row[1] or "").split()
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        if len(w) >= 20 and 100 * len(repeat) <= 30 * len(w) and score[row[0]] >= least:
            out.append(row)
    return out


def plain_lines(docs):
    runs = lambda t: [tuple(t[j * len(t) // 8 : (j + 1) * len(t) // 8]) for j in range(8)]
    lines = {}
    for d, t, *_ in docs:
        for i, line in enumerate(t.split("\n")):
            tokens = tuple("<*>" if any("0" <= c <= "9" for c in w) else w for w in line.split())
            if tokens:
                lines[d, i] = tokens
    leaf = lambda t: (len(t), t[:3])
    busy = Counter(leaf(t) for t in lines.values())
    kinds = defaultdict(list)
    for at, t in lines.items():
        kinds[t].append(at)
    heads = {}
    for t, at in kinds.items():
        rank = (-len(at), min(at))
        if leaf(t) not in heads or rank < heads[leaf(t)][0]:
            heads[leaf(t)] = (rank, t)
    named, text = defaultdict(list), {d: t for d, t, *_ in docs}
    for at, t in lines.items():
        if busy[leaf(t)] >= 10:
            head = heads[leaf(t)][1]
            alike = len(t) >= 8 and sum(a == b for a, b in zip(runs(t), runs(head), strict=True)) >= 7
            named[head if alike else t].append(at)
    gone = {at for own in named.values() if len({text[d] for d, _ in own}) >= 10 for at in own if at != min(own)}
    out = []
    for d, t, lang, source, n in docs:
        kept = [line for i, line in enumerate(t.split("\n")) if (d, i) not in gone]
        if len(kept) == len(t.split("\n")):
            out.append((d, t, lang, source, n))
        elif "\n".join(kept).split():
            out.append((d, "\n".join(kept), lang, source, len("\n".join(kept))))
    return out


def plain_near(docs):
    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [shingles(t) for _, t, *_ in docs], list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if root[a] != root[b] and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((root[a], root[b]))
                root = [x if c == y else c for c in root]
    least = {}
    for r, row in zip(root, docs, strict=True):
        least[r] = min(least.get(r, row), row)
    return sorted(least.values())


def plain_mix(docs):
    """doc_id -> how often it is taken."""
    size = {d: len(t.split()) for d, t, *_ in docs}
    per = Counter()
    for d, _, _, source, _ in docs:
        per[source] += size[d]
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(per), float(sum(per.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 3 * per[s]}
        target |= {s: 3.0 * per[s] for s in full} if full else {s: weight[s] * level for s in open_}
        left -= sum(3 * per[s] for s in full)
        open_ = open_ - full if full else set()
    taken = {}
    for s in per:
        whole = int(target[s] / per[s] + 1e-9) if per[s] else 0
        budget, units = max(0.0, target[s] - whole * per[s]), defaultdict(list)
        for d, _, _, source, _ in docs:
            if source == s:
                units[int(hashlib.md5(str(d).encode()).hexdigest()[:12], 16) >> 12].append(d)
        upto = 0
        for g in sorted(units):
            n = sum(size[d] for d in units[g])
            for d in units[g]:
                taken[d] = whole + (upto + n / 2 < budget)
            upto += n
    return taken


def test_pipeline_against_a_plain_version(spark):
    from tokenizers import Tokenizer

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    left = plain_near(plain_lines(plain_quality(docs, labels)))
    assert 0 < len(left) < len(docs)
    taken = plain_mix(left)
    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = {d: [*t.encode(text, add_special_tokens=False).ids, 1] for d, text, *_ in left}
    found, sequences = Counter(), defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).collect():
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())
        found.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert found == Counter({(d, k): taken[d] for d in ids if taken[d] for k in range(len(ids[d]))})
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
