"""Tokens, packing, SimHash, language identification, decontamination."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shapewright.llm import common, decontaminate, langid, packing, simhash, tokens
from shapewright.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark, texts, schema=DOC):
    """Documents with a null id, repeated rows and columns with clashing names."""
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], None, None, None), (90, None, None, None, None), (91, "", "", "", None)]
    out = spark.createDataFrame(rows, schema)
    for name in ("pid", "rank", "fp", "k", "text_key", "_d", "_k", "count", "a.b"):
        out = out.withColumn(name, F.lit(1))
    return out


def components(near):
    label = np.arange(len(near))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(near))])
        if (new == label).all():
            return label
        label = new


# --- tokens ---

FILES = "byte_bpe_50k.json word_bpe_49k.json piece_bpe_32k.model".split()
CODERS = {name: tokens.load(tokenizer_path(name)) for name in FILES}
CODER, LIBRARY = CODERS[FILES[0]], tokens.HuggingFace(tokenizer_path(), {"added_tokens": [], "pre_tokenizer": {"type": "ByteLevel"}, "model": {"type": "BPE"}})
ODD = st.text(alphabet=st.one_of(st.sampled_from("ab  \n\t'séüÁ\u0301ΣS1#<|>\u3000\x85\u2581🎉日"), st.characters(exclude_categories=["Cs"])), max_size=200)


@settings(max_examples=150, deadline=None)
@given(ODD, st.integers(5, 60), st.integers(1, 8))
def test_ids_are_the_librarys_whole_or_in_chunks(text, chunk, lap):
    want = LIBRARY.ids(text)
    assert np.array_equal(CODER.ids(text), want)
    for coder in (CODER, LIBRARY):
        assert coder.stable and np.array_equal(tokens.encode_long(coder, text, chunk, lap), want)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=ODD, chunk=st.integers(5, 60), lap=st.integers(1, 8))
def test_chunks_give_what_the_whole_gives(name, text, chunk, lap):
    coder = CODERS[name]
    assert coder.stable and np.array_equal(tokens.encode_long(coder, text, chunk, lap), coder.ids(text))


@pytest.mark.parametrize("name", FILES)
def test_texts_of_a_megabyte(name):
    rng = random.Random(6)
    words = ["".join(rng.choice("etaoinshrdlu,.'é日") for _ in range(rng.randrange(1, 12))) for _ in range(999)]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(150_000))
    coder = CODERS[name]
    assert len(text.encode()) > 1_000_000 and np.array_equal(tokens.encode_long(coder, text), coder.ids(text))


def test_a_coder_without_a_proof_takes_whole_texts(tmp_path):
    import json

    spec = json.load(open(tokenizer_path(FILES[1])))
    spec["normalizer"]["normalizers"].append({"type": "Strip", "strip_left": True, "strip_right": True})
    (tmp_path / "other.json").write_text(json.dumps(spec))
    coder = tokens.load(str(tmp_path / "other.json"))
    assert coder.stable is None and np.array_equal(tokens.encode_long(coder, " a b c " * 9, 5, 1), coder.ids(" a b c " * 9))


def test_special_strings_and_unbroken_text():
    for text in ("a<|endoftext|> b<|endoftext|>", "x" * 5000, "word " * 3000, " " * 999 + "a"):
        want = LIBRARY.ids(text)
        assert np.array_equal(CODER.ids(text), want)
        assert np.array_equal(tokens.encode_long(CODER, text, 64, 4), want)
        for coder in CODERS.values():
            assert np.array_equal(tokens.encode_long(coder, text, 64, 4), coder.ids(text))


def test_other_vocabularies():
    assert isinstance(tokens.load(tokenizer_path("word_bpe_49k.json")), tokens.HuggingFace)
    assert len(tokens.encode_long(tokens.load(tokenizer_path("piece_bpe_32k.model")), "a b c")) == 3


def test_counts(spark):
    got = tokens.count_tokens(odd(spark, ["a b", "ü" * 9]), tokenizer_path(), limit=1).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} >= {(0, 3, 2, True), (90, 0, 0, False), (91, 0, 0, False), (None, 3, 2, True)}
    assert tokens.count_tokens(odd(spark, ["a"]).limit(0), tokenizer_path()).collect() == []


@pytest.mark.parametrize("name", FILES)
def test_counts_are_the_librarys(spark, docs, name):
    """The query's result over the whole table, against the library text by text."""
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        count = lambda t: len(model.encode(t))
    else:
        import tokenizers

        model = tokenizers.Tokenizer.from_file(tokenizer_path(name))
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want = {(r.doc_id, len((r.text or "").encode()), n := count(r.text or ""), n > 512) for r in docs.collect()}
    assert {tuple(r) for r in tokens.count_tokens(docs, tokenizer_path(name)).collect()} == want


# --- packing ---


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms.remove(fit)
            rooms.append(fit - n)
    return len(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins, ranks = {}, {}
    for length, rank, n, first, offset in packing.plan(counts, 20):
        assert rank == ranks.get(length, 0)
        ranks[length] = rank + n
        for b in range(first, first + n):
            bins.setdefault(b, []).append((offset, length))
    assert ranks == counts and len(bins) == one_by_one(lengths, 20)
    for held in bins.values():
        held.sort()
        assert all(o == sum(x for _, x in held[:i]) for i, (o, _) in enumerate(held)) and sum(x for _, x in held) <= 20


def check_packing(rows, texts, capacity):
    made = {}
    for r in rows:
        made.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in made.values():
        held.sort()
        assert all(o == sum(x for _, x in held[:i]) for i, (o, _) in enumerate(held)) and sum(x for _, x in held) <= capacity
    for doc_id, text in texts.items():
        ids = np.append(LIBRARY.ids(text or ""), packing.END).astype("<u4")
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc_id)
        assert [p for p, *_ in own] == list(range(len(own))) and own[0][1] == 0 and sum(x[2] for x in own) == len(ids)
        assert all(n == capacity for _, _, n, _ in own[1:])
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in own)


def test_pack(spark, docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_packing(rows, texts, 1024)
    assert len({r.sequence_id for r in rows}) == one_by_one([r.length for r in rows], 1024)
    small = packing.pack(odd(spark, ["a b " * 40, "c"]), tokenizer_path(), capacity=16).collect()
    check_packing(small, {1: "c", 90: None, 91: ""}, 16)
    assert packing.pack(docs.limit(0), tokenizer_path()).collect() == []


# --- SimHash ---


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def clustered(seed, groups=40, copies=25):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, groups, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, groups).astype(np.uint64)
    return np.unique(np.concatenate([base ^ flip() ^ flip() for _ in range(copies)]))


def test_trie_finds_all_pairs():
    for budget in (0, 1, 4):
        keys = clustered(budget)
        keys = np.sort(np.concatenate([keys, keys[:200:3], keys[:1].repeat(99)]))
        i, j = np.triu_indices(len(keys), 1)
        near = np.bitwise_count(keys[i] ^ keys[j]) <= budget
        got = {p for a, b in simhash.trie_pairs(keys, budget) for p in zip(a.tolist(), b.tolist())}
        assert got == set(zip(i[near].tolist(), j[near].tolist()))


@pytest.mark.parametrize("group", [5, 4096])
def test_links_connect_what_pairs_connect(spark, group):
    keys = np.sort(clustered(7).view(np.int64))
    fps = spark.createDataFrame([(int(k),) for k in keys], "fp long")
    got = {r.node: r.component for r in common.components(simhash.links(fps, group=group)).collect()}
    label = components(np.bitwise_count(keys.view(np.uint64)[:, None] ^ keys.view(np.uint64)[None, :]) <= 4)
    assert all(got.get(int(k), int(k)) == int(keys[label[i]]) for i, k in enumerate(keys))


def test_hot_subtries_are_cut_until_they_fit(spark, monkeypatch):
    """All keys share two blocks: only cutting again and again makes units fit."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 42, 60, dtype=np.uint64)
    keys = [b for b in base.tolist()]
    for b in base.tolist():
        for n in (1, 3, 4, 5):
            keys.append(b ^ sum(1 << int(k) for k in rng.choice(42, n, replace=False)))
    keys = np.unique(np.array(keys, dtype=np.uint64))
    fps = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "fp long")
    cuts = []
    pairs = simhash._node_pairs
    monkeypatch.setattr(simhash, "_node_pairs", lambda *a: cuts.append(a[-1]) or pairs(*a))
    got = {r.node: r.component for r in common.components(simhash.links(fps, group=20)).collect()}
    label = components(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 4)
    assert len(cuts) >= 2
    signed = keys.view(np.int64)
    least = {i: min(int(signed[j]) for j in np.flatnonzero(label == label[i])) for i in range(len(keys))}
    assert all(got.get(int(k), int(k)) == least[i] for i, k in enumerate(signed))


def test_near_duplicates(spark, docs):
    rows = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp = np.array([brute_fingerprint(texts[r.doc_id]) for r in rows], dtype=np.uint64)
    assert [r.fingerprint for r in rows] == [f"{x:016x}" for x in fp.tolist()]
    label = components(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert [r.component_id for r in rows] == [rows[i].doc_id for i in label]


def edited(rng, words, n):
    """``words`` with ``n`` words replaced at even distances."""
    words = list(words)
    for k in range(n):
        words[(k * len(words)) // n + rng.randrange(3)] = f"new{rng.randrange(10**6)}"
    return words


def test_similar_texts(spark):
    rng = random.Random(3)
    texts = []
    for size in (60, 400, 3000):
        for _ in range(6):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts += [base, edited(rng, base, max(1, size // 100)), edited(rng, base, size // 4), base[::-1]]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    fp = np.array([np.frombuffer(simhash.wide_fingerprint(t.encode()), dtype="<u8") for _, t in rows])
    label = components(np.bitwise_count(fp[:, None] ^ fp[None, :]).sum(axis=2) <= simhash.WIDE_BUDGET)
    got = {r.doc_id: r.component_id for r in simhash.similar(table).collect()}
    assert [got[i] for i in range(len(rows))] == label.tolist()
    assert [got[i] for i in range(len(rows))] == [i - (i % 4 == 1) for i in range(len(rows))]


def jaccard(a, b):
    own = [{tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} for x in (a.lower().split(), b.lower().split())]
    return len(own[0] & own[1]) / len(own[0] | own[1])


def test_pipeline_links_what_is_similar(spark):
    import corpus_pipeline

    rng = random.Random(4)
    texts = []
    for size in (40, 300, 1500):
        for _ in range(8):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            for share in (0.81, 0.78):  # five shingles go at each replaced word
                other = edited(rng, base, max(1, round((size - 4) * (1 - share) / (1 + share) / 5)))
                texts += [base, other, base[: round(size * share)]]
    texts = [" ".join(x) for x in dict.fromkeys(map(tuple, texts))]
    near = np.array([[jaccard(a, b) >= 0.8 for b in texts] for a in texts])
    assert near.sum() > len(texts) + 30
    label = components(near)
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()}
    assert [got[i] for i in range(len(texts))] == label.tolist()
    kept = corpus_pipeline.drop_near_copies(spark, table, SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.tolist()))


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Chains and clouds of near copies are one component each, by far fewer
    candidates than pairs."""
    rng = random.Random(7)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(9000)}" for _ in range(200)]
        texts += [base] + [edited(rng, base, 2) for _ in range(150)]
        chain = base
        for _ in range(20):
            chain = edited(rng, chain, 3)
            texts.append(chain)
    texts = [" ".join(x) for x in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    label = components(np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]))
    made, real = [], simhash._subtrie_links
    monkeypatch.setattr(simhash, "_subtrie_links", lambda *a: made.append(real(*a)) or made[-1])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label.tolist()
    pairs = {(min(r), max(r)) for m in made for r in m.where("dst is not null").collect()}  # of all rounds
    assert len(pairs) < 60 * len(texts) < sum(np.bincount(label) ** 2) / 2


def loose_cloud(rng, n, far):
    """Texts ``far`` words from one base, which are candidates but mostly no near
    copies of each other; every tenth is a near copy of the one before."""
    base, texts = [f"w{rng.randrange(9000)}" for _ in range(200)], []
    for k in range(n):
        texts.append(edited(rng, texts[-1], 2) if k % 10 == 9 else list(base))
        for at in range(0, 0 if k % 10 == 9 else 200, 200 // far):
            texts[-1][at + rng.randrange(200 // far)] = f"new{rng.randrange(10**6)}"
    return [" ".join(x) for x in texts]


def by_brute_force(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    return components(np.array([[10 * len(a & b) >= 8 * len(a | b) for b in sets] for a in sets]))


def test_candidates_that_are_no_copies_make_few_rows(spark, monkeypatch):
    texts = loose_cloud(random.Random(11), 400, 5)
    label = by_brute_force(texts)
    assert len(set(label.tolist())) > 100
    rows, real = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, name: (made := real(df, name), rows.append((name, made.count())))[0])
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == label.tolist()
    assert max(rows, key=lambda x: x[1])[1] < 20 * len(texts), rows


@pytest.mark.parametrize("far", [2, 4])
def test_groups_too_large_for_a_task(spark, monkeypatch, far):
    texts = loose_cloud(random.Random(12), 150, far) + loose_cloud(random.Random(13), 5, far)
    label = by_brute_force(texts)
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOC)
    for name, most in (("COMPARED", 16), ("COMPARED_BYTES", 20_000)):
        with monkeypatch.context() as m:
            m.setattr(simhash, name, most)
            m.setattr(simhash, "PIVOTS", 4)
            got = {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()}
        assert [got[i] for i in range(len(texts))] == label.tolist()


def shuffled(spark):
    """Bytes of shuffle that each stage so far has written."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


def test_texts_without_candidates_are_not_shuffled(spark):
    rng = random.Random(14)
    texts = [" ".join(f"{rng.randrange(10**9)}" for _ in range(2000)) for _ in range(200)]
    texts += [" ".join(edited(rng, texts[0].split(), 2))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table of candidates that is too large
    try:
        before = shuffled(spark)
        got = {r.doc_id: r.component_id for r in simhash.near_copies(table).collect()}
        after = shuffled(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert got == {i: i % 200 for i in range(201)}
    assert sum(n for k, n in after.items() if k not in before) < sum(map(len, texts)) / 4


def test_heads_tell_what_is_not_similar(spark):
    """Fingerprints that agree in a sample and are near in 128 bits, but not in
    192, are no candidates; those of similar texts are."""
    rng = np.random.default_rng(15)
    rows = []
    for k in range(60):
        own = rng.integers(0, 2, 512, dtype=np.uint8)
        differ = np.zeros(512, dtype=np.uint8)
        if k < 30:
            differ[rng.choice(512, 78, replace=False)] = 1
        else:
            differ[[*rng.choice(64, 12, replace=False), *64 + rng.choice(64, 12, replace=False), *192 + rng.choice(320, 60, replace=False)]] = 1
            differ[128:192] = [1, 0] * 32
        rows += [(2 * k + side, np.packbits(own ^ (side * differ), bitorder="little").tobytes()) for side in (0, 1)]
    dealt = simhash._samples(spark.createDataFrame(rows, "node long, fp binary"), range(simhash.SAMPLES), simhash.HEAD)
    links = simhash._subtrie_links(dealt, simhash.GROUP, simhash.TRIE_BUDGET, simhash.HEAD_BUDGET, True)
    pairs = {(min(r), max(r)) for r in links.collect()}
    assert pairs <= {(2 * k, 2 * k + 1) for k in range(30)} and len(pairs) >= 29


def test_similar_pairs_connect_what_all_pairs_connect():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 30, 90):
        base = rng.integers(0, 1 << 62, (3, 60)).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[k % 3][: rng.integers(40, 60)], rng.integers(0, 1 << 62, rng.integers(0, 9)).astype(np.uint64)])) for k in range(n)]
        sets[1:2] = [np.zeros(0, np.uint64)] * len(sets[1:2])
        of, query = rng.integers(0, n + 1, n), rng.random(n) < 0.5
        own = [set(x.tolist()) for x in sets]
        joined = np.array([[of[i] == of[j] or bool(own[i] and own[j] and (query[i] or query[j]) and 10 * len(own[i] & own[j]) >= 8 * len(own[i] | own[j])) for j in range(n)] for i in range(n)]).reshape(n, n)
        pairs = simhash.similar_pairs(sets, of.tolist(), query.tolist(), 8)
        assert all(joined[i, j] and of[i] != of[j] for i, j in pairs) and len(pairs) < max(1, n)
        found = np.array([[of[i] == of[j] for j in range(n)] for i in range(n)]).reshape(n, n)
        for i, j in pairs:
            found[i, j] = found[j, i] = True
        assert components(found).tolist() == components(joined).tolist()


def test_wide_blocks_keep_all_links(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (3, 64), dtype=np.uint8)
    rows = []
    for k in range(120):
        bits = np.unpackbits(base[k % 3])
        bits[rng.choice(512, 12, replace=False)] ^= 1
        rows.append((k, bytearray(np.packbits(bits).tobytes())))
    classes = spark.createDataFrame(rows, "node long, fp binary")
    for group in (8, 2048):
        found = common.components(simhash.wide_links(classes, group=group))
        assert {r.node: r.component for r in found.collect()} == {k: k % 3 for k in range(120)}


def test_keep_first_in_odd_tables(spark):
    table = odd(spark, ["one two three four five six", "other words stand here in this text", "ONE two three four five six"])
    kept = simhash.keep_first(table)
    assert kept.columns == table.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "90"]
    assert simhash.keep_first(table.limit(0)).collect() == []
    nulls = table.where("doc_id is null")
    assert simhash.keep_first(nulls).count() == 1
    assert simhash.near_duplicates(nulls).first().component_id is None


def test_rows_that_share_an_id(spark):
    a, b = "one two three four five six", "quite other words stand in this one"
    table = spark.createDataFrame([(1, a), (1, a), (1, b), (1, b), (2, a), (3, b), (None, "again some more words for this")], "doc_id long, text string").withColumn("component", F.lit(1)).withColumn("_c", F.lit(1))
    for found in (None, simhash.near_copies(table)):
        kept = simhash.keep_first(table, found)
        assert kept.columns == table.columns and sorted((str(r.doc_id), r.text[:3]) for r in kept.collect()) == [("1", "one"), ("1", "qui"), ("None", "aga")]


def test_long_text_needs_no_long_list():
    text = " ".join(f"w{i % 977}" for i in range(200_000)).encode()
    whole, simhash.STEP = simhash.STEP, 1000
    try:
        assert simhash.fingerprint(text) == brute_fingerprint(text.decode())
    finally:
        simhash.STEP = whole


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 300)]
    rng.shuffle(path)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(path, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 150)}
    assert common.components(spark.createDataFrame([], "src long, dst long")).collect() == []


# --- language identification ---


def test_languages_of_held_out_documents(spark):
    """Declared languages and hosts hidden: the text and corpus prior alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("truth", F.col("lang")).withColumn("lang", F.when(F.xxhash64("doc_id", F.lit(4)) % 3 == 0, F.col("lang")))
    got = langid.identify(hidden.withColumn("source", F.lit(None).cast("string"))).join(hidden.where("lang is null").select("doc_id", "truth"), "doc_id").collect()
    assert sum(r.predicted == r.truth for r in got) >= 0.98 * len(got)
    assert sum(r.accepted for r in got) >= 0.99 * len(got)


def test_rejections(spark, docs):
    strange = spark.createDataFrame([(9001, "", "en", "a.net", 0), (9002, None, None, None, 0), (9003, "12 34 !!", "en", "a.net", 0), (9004, "qxzj vkwq zxqv jjqz wvxk qzzx kxqj " * 9, None, None, 0)], DOC)
    rows = {r.doc_id: r for r in langid.identify(docs.unionByName(strange)).where("doc_id > 9000").collect()}
    assert not any(rows[i].accepted for i in (9001, 9002, 9003, 9004)) and rows[9001].predicted is None
    kept = langid.keep_known(docs.unionByName(strange))
    assert kept.columns == docs.columns and kept.count() == docs.count()
    table = odd(spark, ["the cat sat on the mat with that", "words and more of the words"])
    assert langid.identify(table).count() == table.count()
    assert langid.identify(table.limit(0)).collect() == []
    assert {r.predicted for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {None}


def test_rare_languages(spark, docs):
    """No share decides which languages are known: neither with a model of their
    own nor without one are texts of a rare language another's."""
    german = docs.where("lang = 'de'").orderBy(F.desc("n_chars")).limit(1).withColumn("doc_id", F.lit(9000).cast("long"))
    others = docs.where("lang <> 'de'")
    many = others
    for k in range(1, 8):
        many = many.unionByName(others.withColumn("doc_id", F.col("doc_id") + 10_000 * k))
    more = [(9001, "Straßenverkehr überführt möglichst großzügig " * 3, "de-AT", None, 0), (9002, "これは日本語の文章です。とても短いですが、日本語です。", "ja", "x.jp", 0), (9003, "the and of that with this from which " * 3, "tlh", None, 0)]
    table = many.unionByName(german).unionByName(spark.createDataFrame(more, DOC))
    rows = {r.doc_id: r for r in langid.identify(table).where("doc_id between 9000 and 9003").collect()}
    assert {i: (rows[i].predicted, rows[i].accepted) for i in (9000, 9001, 9002)} == {9000: ("de", True), 9001: ("de", True), 9002: ("ja", True)}
    assert rows[9003].accepted
    short = others.unionByName(spark.createDataFrame([(9004, german.first().text[:600], "DE", None, 0)], DOC))
    row = langid.identify(short).where("doc_id = 9004").first()
    assert (row.predicted, row.accepted) == ("de", True)


def test_posteriors_by_brute_force(spark, docs):
    """All evidence again in numpy, one document at a time."""
    strange = [(9001, "12 34 !!", "en", "a.net", 0), (9002, "qxzj vkwq zxqv jjqz wvxk qzzx kxqj " * 9, None, None, 0), (None, "un texte sans hôte déclaré", "Xhosa", None, 0), (9004, "words of the", "en_GB", "new.zz", 0)]
    table = docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang"))).unionByName(spark.createDataFrame(strange, DOC))
    langs, model = langid.fit(table)
    k = len(langs)
    rows = [(r, *langid.trigrams(r.text or "")) for r in table.collect()]
    like = [model[c].sum(axis=0, dtype=float) * min(1, langid.EFFECTIVE / max(1, len(c))) for _, c, _ in rows]
    tag = lambda x: None if x is None else x.lower().split("_")[0]
    counts = lambda rows: np.bincount([int(v[:k].argmax()) for v in rows], minlength=k) if rows else np.zeros(k)
    fine = [i for i, (_, _, n) in enumerate(rows) if n >= langid.LEAST_LETTERS]
    host = [r.source or "" for r, _, _ in rows]
    corpus = counts([like[i] for i in fine])
    root = (corpus + 1) / (corpus.sum() + k)
    heard = np.ones((k, k + 1))
    for i in fine:
        if (lang := tag(rows[i][0].lang)) is not None:
            heard[int(like[i][:k].argmax()), langs.index(lang) if lang in langs else k] += 1
    heard = np.log(heard / heard.sum(axis=1, keepdims=True))
    got = {(r.doc_id, r.text_key): r for r in langid.identify(table).collect()}
    keys = [(r.doc_id, r.k) for r in table.select("doc_id", F.xxhash64("text").alias("k")).collect()]
    assert len(got) == len(rows)
    for i, (r, _, letters) in enumerate(rows):
        have = got[keys[i]]
        assert have.n_letters == letters
        if letters < langid.LEAST_LETTERS:
            assert (have.predicted, have.posterior, have.accepted) == (None, None, False)
            continue
        prior = root
        for rest in ([j for j in fine if host[j].split(".")[-1].lower() == host[i].split(".")[-1].lower()], [j for j in fine if host[j] == host[i]]):
            n = counts([like[j] for j in rest])
            prior = (n + langid.SMOOTH * prior) / (n.sum() + langid.SMOOTH)
        lang = tag(r.lang)
        p = np.exp(like[i][:k] + np.log(prior) + (0 if lang is None else heard[:, langs.index(lang) if lang in langs else k]))
        other = lang is not None and lang not in langs
        own = (np.exp(like[i][k]) + 1) / 2 * langid.UNKNOWN if other else 0
        no = langid.UNKNOWN * (langid.STRAY if other else 1)
        total = p.sum() + own + no
        assert have.predicted == (lang if own > p.max() else langs[int(p.argmax())])
        assert abs(have.posterior - max(p.max(), own) / total) < 1e-6
        assert have.accepted == ((p.sum() + own) / total >= 0.5)


def test_hosts_speak_for_unclear_texts(spark, docs):
    unclear = [(9000 + i, "zzz", None, "de.net" if i % 2 else "en.org", 0) for i in range(2)]
    host = [(8000 + i, r.text, r.lang, f"{r.lang}.{'net' if r.lang == 'de' else 'org'}", 0) for i, r in enumerate(docs.where("lang in ('de', 'en')").collect())]
    rows = langid.identify(spark.createDataFrame(host + unclear, DOC)).where("doc_id >= 9000").collect()
    assert {r.doc_id: r.predicted for r in rows} == {9000: "en", 9001: "de"}


# --- decontamination ---

ITEMS = [(1, "Anna buys 5 apples and 3 pears at the market and pays 12 dollars for all of them today"), (2, "too short"), (3, None), (4, "what is the sum of these seven lovely numbers that nobody has ever written down")]


def test_questions_and_their_variants(spark):
    filler = "Some words go before the question. "
    texts = [
        filler + ITEMS[0][1] + ". More follows.",
        filler + "Anna buys 7 apples and 8 pears at the market and pays 20 dollars for all of them today.",
        filler + "Anna buys 7 apples and 7 pears at the market and pays 20 dollars for all of them today.",
        filler + "Anna buys apples. He sells pears at the market.",
        ITEMS[3][1].upper().replace(" ", "\n"),
        filler + "what is the sum of these seven lovely numbers which nobody has ever written down",
        "x " * 50_000 + ITEMS[3][1],
    ]
    got = decontaminate.matches(odd(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.reparameterised) for r in got} == {(0, 1, False), (None, 1, False), (1, 1, True), (4, 4, False), (5, 4, False), (6, 4, False)}


def test_repeated_clauses_are_found(spark):
    item = "Tom has 3 red apples and Anna has 5 red apples and Bob has 7 red apples so how many red apples are there"
    copies = [("go " * n + "there. ") * (n > 0) + item for n in range(17)]
    other = item.replace("3", "30").replace("5", "50").replace("7", "70")
    wrong = item.replace("3", "8").replace("5", "8").replace("7", "9")
    added = item.replace("and Bob", "and then Bob")
    table = spark.createDataFrame(list(enumerate([*copies, other, wrong, added])), "doc_id long, text string")
    got = {r.doc_id: (r.coverage, r.reparameterised) for r in decontaminate.matches(table, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {i: got.get(i) for i in range(18)} == {i: (1.0, i == 17) for i in range(18)}
    assert 18 not in got and got[19][0] >= 0.8 and not got[19][1]


def test_items_of_numbers_are_found(spark):
    items = [(1, "What is the next number in the sequence 2, 4, 8, 16, 32, 64, 128"), (2, "Compute 12 + 7 - 5 * 3"), (3, "Add 1, 2 and 3"), (4, "2 4 6")]
    texts = [f"Some words go before it. {t}. More words." for _, t in items]
    texts += ["Some words. What is the next number in the sequence 3, 9, 27, 81, 243, 729, 2187", "Compute 12 + 7 - 6 * 3", "Compute 1 + 2 - 3 * 4"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.reparameterised) for r in decontaminate.matches(table, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i + 1): (1.0, False) for i in range(4)}


def brute_matches(texts, items):
    """{(doc, item): (coverage, reparameterised)}: every window of every document
    against every window of every item, compared word by word."""
    v = decontaminate.Vocabulary()

    def read(text):
        code, slot, (at, words) = v.template(text or "")
        return code.tolist(), slot.tolist(), [words.values[a] for a in at] if len(code) else []

    out = {}
    read_docs, read_items = {i: read(t) for i, t in texts.items()}, {i: read(t) for i, t in items.items()}
    for j, (code, slot, own) in read_items.items():
        n = len(own)
        w = n if n < decontaminate.LEAST_WORDS else min(decontaminate.WINDOW, n)
        for i, (dcode, dslot, theirs) in read_docs.items():
            if not n or (n < decontaminate.LEAST_WORDS) != (len(theirs) < decontaminate.LEAST_WORDS) or (n < decontaminate.LEAST_WORDS and n != len(theirs)):
                continue
            bands = {}
            for at in range(n - w + 1):
                free = sum(slot[at : at + w])
                for pos in range(len(theirs) - w + 1):
                    hits = []
                    if own[at : at + w] == theirs[pos : pos + w]:
                        hits.append((own[at : at + w], theirs[pos : pos + w]))
                    if 0 < free <= w - min(decontaminate.LITERAL, w) and code[at : at + w] == dcode[pos : pos + w]:
                        hits.append(([x for x, s in zip(own[at : at + w], slot[at:]) if s], [x for x, s in zip(theirs[pos : pos + w], dslot[pos:]) if s]))
                    for a, b in hits:
                        d = pos - at
                        for band in (d // decontaminate.DRIFT * 2, (d + decontaminate.DRIFT // 2) // decontaminate.DRIFT * 2 + 1):
                            bands.setdefault(band, []).append(dict(at=at, pos=pos, width=w, theirs=a, slots=b))
            best = [x for x in (decontaminate.chained(found, n) for found in bands.values()) if x]
            if best:
                out[i, j] = max(c for c, _ in best), min(o for _, o in best)
    return out


def test_matches_by_brute_force(spark, docs):
    rng = random.Random(12)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    names, things = "Tom Anna Franz Sophie Paul Quentin Zoe".split(), "apples pears books km dollars red blue".split()
    items = {r.item_id: r.text for r in bench[:20]}
    for k in range(1000, 1040):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice([["Which", "of", "the", "following", "is"], [rng.choice(names), "has", str(rng.randrange(9)), rng.choice(things), "and"], [str(rng.randrange(9)), "+", str(rng.randrange(99)), "-", str(rng.randrange(9))], ["in", "1914", rng.choice(names), rng.choice(names)], ["how", "many", rng.choice(things), "are", "there?"]])
        items[k] = " ".join(parts)
    items |= {1040: "Which of the following", 1041: "7", 1042: "two words", 1043: "?!", 1044: None, 1045: ""}
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()}
    held = {}
    for k, item in enumerate(items.values()):
        if item and any(c.isalnum() for c in item):
            lead = "some words go here " * rng.randrange(4) if len(item.split()) > 2 else ""
            texts[5000 + k], held[5000 + k] = lead + rng.choice([item, item.lower(), item.upper() if item.isascii() else item, item.replace(" ", "\n")]) + (" and on" if lead else ""), list(items)[k]
            texts[6000 + k] = "".join(str(rng.randrange(99)) if c.isdigit() else c for c in item)
            texts[7000 + k] = " ".join(w for w in item.split() if rng.random() < 0.9)
    table = spark.createDataFrame([*texts.items(), (5000, texts[5000])], "doc_id long, text string")
    rows = decontaminate.matches(table, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): (round(r.coverage, 9), r.reparameterised) for r in rows}
    assert len(got) == len(rows)
    assert got == {k: (round(c, 9), o) for k, (c, o) in brute_matches(texts, items).items()}
    assert all(got.get((i, j), (0, True)) == (1.0, False) for i, j in held.items())


def test_phrases_that_many_items_share_join_nothing(spark):
    """The windows that candidates come from are an item's rarer ones."""
    items = spark.createDataFrame([(i, f"Which of the following is the right answer to the item {chr(97 + i % 26)}{chr(97 + i // 26)}q about w{i} x{i} y{i} z{i}") for i in range(200)], "item_id long, text string")
    made = decontaminate._windows(items, "item_id", None, None).distinct()
    rare = decontaminate._rare(made)
    often = rare.groupBy("h").count().where("count > 100").count()
    assert often < made.groupBy("h").count().where("count > 100").count()
    assert rare.select("item").distinct().count() == 200


def test_clean_documents_stay(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: " ".join(t.lower().split())
    items = [norm(r.text) for r in bench.collect()]
    leaks = {r.doc_id for r in docs.collect() if any(i in norm(r.text) for i in items)}
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - leaks
    assert decontaminate.matches(docs, bench.limit(0)).collect() == []
    assert decontaminate.matches(docs.limit(0), bench).collect() == []


def test_vocabulary_may_be_dropped():
    small, large = decontaminate.Vocabulary(most=3), decontaminate.Vocabulary()
    for text in ("a b c d e f.", "G h i 5 kg", "a b G"):
        assert (small.template(text)[0] == large.template(text)[0]).all()
