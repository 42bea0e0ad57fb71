"""Mixing, encoding, SimHash, toxicity, sharding and line dedup on small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import bpe, components, lines, mixing, sharding, simhash, toxicity
from ledgerline.llm.work import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, ids string"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def frame(spark, rows):
    """Rows (doc_id, text, source); more columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, -1, -2, "x") for i, t, s in rows], DOCS)


ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (4, "one", "b"), (None, "two words", "b"),
    (5, "word " * 40_000, "a"), (6, "é你好 \U0001f469‍\U0001f467 a b", "a"), (7, "<|endoftext|> don't 's", None),
    (8, "tail  \n\n space \r\n", "b"),
]


# --- mixing


def word_count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def waterfill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] >= most * sizes[s]]
        if not over:
            return {s: float(full.get(s, level * weight[s])) for s in names}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 300)), "abcde"[min(4, i % 13)]) for i in range(900)]
    rows += [(1000 + i, "x y z", None) for i in range(20)] + [(2000, None, "e"), (2001, "", "f")]
    out = mixing.mix(frame(spark, rows), Scratch(spark, "t"))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken", "shard_words"]
    got = {r.doc_id: r for r in out.collect()}
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += word_count(text)
    target, taken, shards = waterfill(sizes), Counter(), Counter()
    assert len(got) == len(rows)
    for i, text, source in rows:
        r = got[i]
        assert r.size == word_count(text) and r.source_size == sizes[source] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[source], rel=1e-12)
        taken[source] += r.taken
        words = [int(w) for w in r.shard_words.split(",")]
        assert sum(words) == r.taken and min(words) >= 0 and len(words) == 8
        shards.update(dict(enumerate(words)))
    block = mixing.Recipe().block
    assert all(abs(taken[s] - target[s]) <= 2 * block for s in sizes)
    assert max(shards.values()) - min(shards.values()) <= block * (1 + 2 * len(sizes))
    again = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows[::-1]), Scratch(spark, "t")).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_mix_of_coarse_blocks_and_long_runs(spark):
    rows = [(i, "w " * 97, "ab"[i % 5 == 0]) for i in range(500)]
    recipe = mixing.Recipe(block=243)
    got = mixing.mix(frame(spark, rows), Scratch(spark, "t"), recipe).collect()
    for source_size in {r.source_size for r in got}:
        own = [r for r in got if r.source_size == source_size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * recipe.block


def test_quotas_are_sainte_lague_for_every_shard(spark):
    targets = {1: 5.2e5, 2: 3.1e4, 3: 999.0, 4: 0.0, 5: 2.5e5}
    goal = sum(targets.values())
    sources = spark.createDataFrame([(s, t, goal) for s, t in targets.items()], "sid int, target double, goal double")
    recipe = mixing.Recipe(block=805, shards=4)
    got = mixing.quotas(sources, recipe).collect()
    total = round(goal / recipe.block)
    seats = sorted(((-t / (2 * k + 1), s, k) for s, t in targets.items() if t for k in range(total)))[:total]
    for shard in range(4):
        want = Counter(s for _, s, _ in seats[: total * (shard + 1) // 4])
        have = Counter({s: sum(r.quota for r in got if r.sid == s and r.shard <= shard) for s in targets})
        assert {s: n for s, n in have.items() if n} == dict(want)


def test_mix_odd_rows_and_no_rows(spark):
    got = mixing.mix(frame(spark, ODD), Scratch(spark, "t")).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, word_count(t)) for i, t, _ in ODD)
    assert mixing.mix(frame(spark, []), Scratch(spark, "t")).collect() == []


def test_mixed_texts_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 50)), "abc"[i % 3]) for i in range(200)] + [(900, None, "a")]
    df = frame(spark, rows)
    plan = {r.doc_id: r.taken for r in mixing.mix(df, Scratch(spark, "t")).collect()}
    out = mixing.mixed_texts(df, Scratch(spark, "t"))
    assert out.columns == df.columns
    words, text = Counter(), dict((i, t) for i, t, _ in rows)
    for r in out.collect():
        words[r.doc_id] += word_count(r.text)
        assert r.n_chars == len(r.text) and r.size == -2
        assert set((r.text).split()) <= set(text[r.doc_id].split())
    assert {i: n for i, n in plan.items() if n} == {i: n for i, n in words.items() if n}


@pytest.mark.parametrize("block", [1, 75])
def test_pipeline_mix_leaves_documents_whole(spark, block):
    """At block lengths of 1 and of many words alike."""
    rows = [(i, f"  Head {i}\n\n" + "\n".join(f"w{i}_{j}\tx" for j in range(5 + i % 40)) + "\n", "abcd"[min(3, i % 7)]) for i in range(300)]
    rows += [(1, f"same size {k}", "a") for k in range(50)]
    df, recipe = frame(spark, rows), mixing.Recipe(stride=1, block=block)
    plan = mixing.mix(df, Scratch(spark, "t"), recipe).collect()
    whole, cut, words = {(i, s, t) for i, t, s in rows}, defaultdict(set), Counter()
    for r in mixing.mixed_texts(df, Scratch(spark, "t"), recipe).collect():
        words[r.source] += word_count(r.text)
        if (r.doc_id, r.source, r.text) not in whole:
            assert any(r.text in t for i, s, t in whole if (i, s) == (r.doc_id, r.source))
            cut[r.source].add(r.doc_id)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += word_count(t)
    taken = Counter()
    for r in plan:
        taken[next(s for s in sizes if sizes[s] == r.source_size)] += r.taken
    assert len(set(sizes.values())) == len(sizes) and words == taken
    assert all(len(c) <= 2 for c in cut.values())


# --- encoding


def reference_encoder():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_codec_agrees_with_the_rank_encoder():
    coder, plain = bpe.codec(PATH, PATTERN), reference_encoder()
    texts = [t or "" for _, t, _ in ODD]
    texts += ["a  b c", "x \ny z", " lead", "trail ", "\nab c", "\n\n x", "tab\t a", "'s's'll ''", "a\x00b", "　 x  y"]
    texts += ["".join(f"a{chr(c)}1 {chr(c)}b\n" for c in range(1, 0x30000, 7) if not 0xD800 <= c < 0xE000)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == plain.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_spans_cover_split_characters():
    coder = bpe.codec(PATH, PATTERN)
    text = "ab \U0001f469‍\U0001f467 c"
    (ids,) = coder.encode([text])
    begins, ends = coder.spans(text, ids)
    raw = [coder.bytes_of[i] for i in ids.tolist()]
    assert all(part in text[a:b].encode() for part, a, b in zip(raw, begins.tolist(), ends.tolist()))
    assert begins[0] == 0 and ends[-1] == len(text) and len(ids) > len(text) - 3


def test_other_patterns_and_an_emptied_memory(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 1)
    coder, plain = bpe.Codec(PATH, r"\p{N}|\P{N}+"), None
    plain = tiktoken.Encoding("o", pat_str=r"\p{N}|\P{N}+", mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    texts = ["year 1999 ended", "no numbers here", ""]
    assert [x.tolist() for x in coder.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_digests_and_round_trip(spark):
    df, plain = frame(spark, ODD), reference_encoder()
    out = bpe.digests(df, PATH, PATTERN)
    want = Counter()
    for i, t, _ in ODD:
        ids = plain.encode_ordinary(t or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    back = bpe.decoded(bpe.encoded(df, PATH, PATTERN), PATH, PATTERN)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t, _ in ODD)
    assert bpe.digests(frame(spark, []), PATH, PATTERN).collect() == []


# --- SimHash


def test_encoding_answers_in_bounded_batches(spark):
    """Whole rows in order, and never the ids of a whole batch of long texts at once."""
    rows = [(i, None if i % 50 == 7 else f"{i} " + "a1 \u00e9" * 1000) for i in range(4000)]
    df = frame(spark, [(*r, "s") for r in rows]).select("doc_id", "text")

    class Taken:
        schema = df.schema

        def mapInArrow(self, run, schema):
            return run

    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
    out = list(bpe.encoded(Taken(), PATH, PATTERN)(iter([batch])))
    assert [i for b in out for i in b.column("doc_id").to_pylist()] == [i for i, _ in rows]
    assert max(b.column("ids").nbytes for b in out) < 30_000_000 < sum(b.column("ids").nbytes for b in out)
    plain = reference_encoder()
    for b in (out[0], out[-1]):
        for r in b.slice(b.num_rows - 10).to_pylist():
            text = rows[r["doc_id"]][1] or ""
            assert r["ids"] == plain.encode_ordinary(text) and r["n_tokens"] == len(r["ids"])
            assert len(r["begins"]) == len(r["ends"]) == len(r["ids"]) and (r["ends"] or [0])[-1] == len(text)


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    votes = Counter()
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(parts))


def test_fingerprints_like_the_plain_rule(spark):
    got = simhash.with_fingerprints(frame(spark, ODD).select("doc_id", "text"), "text", "fp").collect()
    want = Counter((i, slow_fingerprint(t)) for i, t, _ in ODD)
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == want


def smallest_reachable(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("prefix_variants", [1 << 21, 1 << 12])
def test_links_find_every_pair_within_four_bits(spark, monkeypatch, prefix_variants):
    monkeypatch.setattr(simhash, "VARIANTS", prefix_variants)
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)] + [0, (1 << 64) - 1]
    prints = set(base)
    for b in base:
        for flips in (1, 2, 3, 4, 4, 5, 6):
            prints.add(b ^ sum(1 << int(i) for i in rng.choice(64, flips, replace=False)))
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    got = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(df, Scratch(spark, "t")).collect()]
    want = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    assert smallest_reachable(prints, got) == smallest_reachable(prints, want)


def test_crowded_prefixes_are_dealt_on(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROWS", 20)
    prints = [(1 << 40) + i for i in range(0, 3000, 37)]
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    got = [(r.a, r.b) for r in simhash.links(df, Scratch(spark, "t")).collect()]
    want = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    assert smallest_reachable(prints, got) == smallest_reachable(prints, want)


def test_groups_of_copies(spark):
    long = " ".join(f"word{i % 91} and{i}" for i in range(400))
    rows = [(9, long, "a"), (3, long.upper(), "a"), (12, long + " end", "b"), (None, long, "a"), (20, None, "a"), (18, "", "a"), (21, "x", "a")]
    df = frame(spark, rows)
    got = Counter((r.doc_id, r.component_id) for r in simhash.groups(df, Scratch(spark, "t")).collect())
    assert got == Counter([(9, 3), (3, 3), (12, 3), (None, 3), (20, 18), (18, 18), (21, 21)])
    kept = simhash.deduplicated(df.union(df), Scratch(spark, "t"))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 18, 21]
    nameless = frame(spark, [(None, "only here", "a"), (None, "only here", "a"), (None, "and only there", "b")])
    assert sorted(r.text for r in simhash.deduplicated(nameless, Scratch(spark, "t")).collect()) == ["and only there", "only here"]
    assert simhash.groups(frame(spark, []), Scratch(spark, "t")).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = chain + star + [(5000, 5000), (-7, 900), (900, -7), (None, 3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected(df, Scratch(spark, "t")).collect()}
    nodes = {x for e in edges if None not in e for x in e}
    assert got == smallest_reachable(nodes, [e for e in edges if None not in e])
    assert components.connected(df.limit(0), Scratch(spark, "t")).collect() == []


# --- toxicity


def labelled(spark, n=400):
    rng = np.random.default_rng(8)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        bad = int(rng.random() < 0.3)
        words = rng.choice(plain, 40).tolist() + (["zorgish"] * 1 if bad else [])
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, bad))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    more = frame(spark, [(5000, None, "a"), (5001, "", "a"), (5002, "Zorgish!", "a"), (5002, "zorg " * 9, "a"), (None, "zorgish", "a")])
    out = toxicity.scores(docs.union(more), labels, Scratch(spark, "t"))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    true = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in true]
    assert held and all(r.predicted == true[r.doc_id] for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    by = {(r.doc_id, round(r.score, 9)) for r in got}
    assert len({s for i, s in by if i in (5000, 5001)}) == 1
    kept = toxicity.without_toxic(docs, labels, Scratch(spark, "t"))
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, bad in true.items() if not bad}


def test_pairs_of_terms_are_learned():
    """Either of two terms alone is harmless, both together are not: no sum of weights tells that."""
    rng = np.random.default_rng(9)
    rows, y = [], []
    for _ in range(1500):
        a, b = int(rng.random() < 0.5), int(rng.random() < 0.5)
        rows.append(np.array(sorted([*([1] if a else []), *([2] if b else []), 10 + int(rng.integers(5))]), np.int64))
        y.append(float(a == b == 1))
    machine = toxicity.fit(rows, np.array(y), toxicity.Settings(epochs=40))
    place = {int(k): i for i, k in enumerate(machine.keys)}
    def score(*t):
        return machine.score(np.array([place[x] for x in t if x in place], np.int64))

    assert score(1, 2) > 0.5 > max(score(1), score(2), score())


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 20)
    got = toxicity.scores(docs, labels.limit(0), Scratch(spark, "t")).collect()
    assert len(got) == 20 and {r.predicted for r in got} <= {0, 1}
    assert toxicity.scores(docs.limit(0), labels, Scratch(spark, "t")).collect() == []


# --- sharding


def test_shards(spark):
    got = sharding.document_shards(frame(spark, ODD * 2)).collect()
    assert len(got) == 2 * len(ODD)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ODD * 2)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert sharding.document_shards(frame(spark, [])).collect() == []


def test_shards_follow_weights_and_move_little(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k").withColumn("shard", F.lit("clash"))
    weights = {0: 1.0, 1: 2.0, 2: 1.0, 3: 0.0}
    out = sharding.assign(keys, ["k"], weights)
    out = sharding.assign(out, ["k"], weights | {4: 4.0}, "grown")
    share = {r.shard: r["count"] / 20_000 for r in out.groupBy("shard").count().collect()}
    assert set(share) == {0, 1, 2} and abs(share[1] - 0.5) < 0.02
    moved = out.filter("shard != grown")
    assert moved.filter("grown != 4").isEmpty() and abs(moved.count() / 20_000 - 0.5) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(keys, ["k"], {0: 0.0})


# --- lines


def slow_line_dedup(rows):
    """Kept texts by brute force: all pairs of lines, first line of each component stays."""
    found = []
    for i, text in rows:
        for n, raw in enumerate(text.split("\n")):
            line = raw.lower().strip(" \t\r\x0b\x0c")
            if line:
                found.append((i, n, line))
    distinct = sorted({x[2] for x in found})
    sets = [lines.shingles(x) for x in distinct]
    alike = [
        (distinct[i], distinct[j])
        for i in range(len(sets))
        for j in range(i)
        if lines.similarity(sets[i], sets[j]) >= lines.ALIKE
    ]
    part, seen, gone = smallest_reachable(distinct, alike), set(), set()
    for i, n, line in sorted(found):
        if part[line] in seen:
            gone.add((i, n))
        seen.add(part[line])
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def varied(rng, line, changes):
    letters = list(line)
    for at in rng.choice(len(letters), changes, replace=False):
        letters[int(at)] = "#"
    return "".join(letters)


def test_lines_like_brute_force(spark):
    rng = np.random.default_rng(10)
    syllables = ["ba", "ko", "ri", "tu", "sel", "mon", "dra", "pi"]
    def text(n):
        return " ".join("".join(rng.choice(syllables, 3)) for _ in range(n))

    base = [text(25) for _ in range(12)]
    rows = []
    for i in range(120):
        own = [text(int(rng.integers(1, 20))) for _ in range(3)]
        own.append(varied(rng, base[i % 12], int(rng.integers(0, 3))))
        rows.append((i, "\n".join([own[3], *own[:3]] if i % 2 else own)))
    rows += [(500, "Short\nshort\n\n  \n" + base[0].upper() + "  "), (501, "\n".join([text(400)] * 3))]
    got = lines.cleaned(frame(spark, [(i, t, "a") for i, t in rows]), Scratch(spark, "t"))
    assert {r.doc_id: r.text for r in got.collect()} == slow_line_dedup(rows)


def test_buckets_are_compared_in_chunks(spark, monkeypatch):
    """Lines that are alike in a chain, so that few link to the bucket's center."""
    monkeypatch.setattr(lines, "CHUNK", 4)
    rng = np.random.default_rng(12)
    letters = list("the quick brown fox jumps over the lazy dog while seven wizards box in the old town hall at noon " * 2)
    rows = []
    for i in range(40):
        letters[4 + 4 * i % (len(letters) - 8)] = "0123456789"[i % 10]
        rows.append((i, "".join(letters)))
    order = rng.permutation(40).tolist()
    rows = [(i, rows[j][1]) for i, j in enumerate(order)]
    got = lines.cleaned(frame(spark, [(i, t, "a") for i, t in rows]), Scratch(spark, "t"))
    assert {r.doc_id: r.text for r in got.collect()} == slow_line_dedup(rows)


def test_unlike_lines_of_a_bucket_are_not_compared(monkeypatch):
    phrases = [" ".join(hashlib.sha256(f"{i}.{j}".encode()).hexdigest()[:9] for j in range(6)) for i in range(10)]
    texts = [" ".join(phrases[i] for i in chosen) for chosen in combinations(range(10), 5) if sum(chosen) % 5 == 0]
    texts.append(texts[3] + " more")
    n = len(texts)
    bucket = pd.DataFrame({"band": 7, "left": 0, "right": 0, "chunk": 0, "key": range(n), "similarity": 0.5})
    bucket["bands"], bucket["spelled"] = [np.array([7])] * n, texts
    seen, similarity = [], lines.similarity
    monkeypatch.setattr(lines, "similarity", lambda a, b: seen.append(1) or similarity(a, b))
    assert lines._among(bucket).to_numpy().tolist() == [[n - 1, 3]]
    assert len(seen) < n


def test_similarities_are_exact():
    texts = ["a", "A", "ab", "one line of text", "One line of texts", "another line of text, of text, of text"]
    at = [(7 * i) % 6 for i in range(36)]
    wanted = [lines.similarity(lines.shingles(texts[i % 6]), lines.shingles(texts[j])) for i, j in enumerate(at)]
    assert lines._similarities([texts[i % 6] for i in range(36)], texts, at) == wanted


def test_short_lines_go_like_others(spark):
    long = "a line that is long enough to count"
    rows = [(1, "Of.\n\n" + long), (2, "own words of the second\n Of. \nof."), (3, "Of.\n" + long), (4, "你好。\n你好。\n\n"), (5, "你好。")]
    df = frame(spark, [(i, t, "a") for i, t in rows])
    got = {r.doc_id: (r.text, r.lines_before, r.lines_after) for r in lines.cleaned(df, Scratch(spark, "t")).collect()}
    assert got == {
        1: ("Of.\n\n" + long, 3, 3), 2: ("own words of the second", 3, 1), 3: ("", 2, 0),
        4: ("你好。\n\n", 4, 3), 5: ("", 1, 0),
    }
    assert {r.doc_id for r in lines.deduplicated(df, Scratch(spark, "t")).collect()} == {1, 2, 4}
    short = frame(spark, [(1, "a\na", "a")])
    assert [r.text for r in lines.cleaned(short, Scratch(spark, "t")).collect()] == ["a"]


def test_line_dedup_odd_rows(spark):
    long = "a line that is long enough to count"
    rows = [*ODD, (30, long, "a"), (31, long + "\nand this one is its own", "a"), (32, long, "a"), (32, long, "a"), (None, long, "b")]
    df = frame(spark, rows)
    found = lines.cleaned(df, Scratch(spark, "t"))
    assert set(found.columns) == {*df.columns, "lines_before", "lines_after"}
    got = defaultdict(set)
    for r in found.collect():
        got[r.doc_id].add((r.text, r.lines_before, r.lines_after))
    assert got[1] == {(None, 0, 0)} and got[2] == {("", 1, 1)} and got[30] == {(long, 1, 1)}
    assert got[31] == {("and this one is its own", 2, 1)} and got[32] == {("", 1, 0)}
    kept = lines.deduplicated(df, Scratch(spark, "t"))
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 4, None, 5, 6, 7, 8, 30, 31])
    assert lines.cleaned(frame(spark, []), Scratch(spark, "t")).collect() == []
