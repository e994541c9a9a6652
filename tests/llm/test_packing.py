import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scatterlake.llm.packing import Limits, WordTokenizer, pack, pack_documents, packing_query

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, tokens, limits):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_seq[p.sequence].append(p)
        by_doc[p.example].append(p)
    for i, n in enumerate(tokens):
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == n
    for rows in by_seq.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= limits.tokens and len(rows) <= limits.segments
    return {s: sum(p.length for p in rows) for s, rows in by_seq.items()}


def test_cut_packing_wastes_nothing():
    rng = random.Random(1)
    for n in (1, 2, 50, 400):
        tokens = [rng.choice([1, 3, 50, 700, 4096, 9000, rng.randint(1, 5000)]) for _ in range(n)]
        sizes = check(pack(tokens), tokens, Limits())
        assert all(v & (v - 1) == 0 for v in sizes.values())
    assert pack([]) == []


def test_limits_hold_in_every_dimension_without_cutting():
    rng = random.Random(2)
    tokens = [rng.randint(1, 100) for _ in range(300)]
    loss = [rng.randint(0, t) for t in tokens]
    limits = Limits(128, 5, 60)
    tokens = [t for t, x in zip(tokens, loss) if x <= 60]
    loss = [x for x in loss if x <= 60]
    pieces = pack(tokens, loss, limits, cut=False)
    check(pieces, tokens, limits)
    by_seq = defaultdict(int)
    for p in pieces:
        by_seq[p.sequence] += loss[p.example]
    assert max(by_seq.values()) <= 60
    assert len(by_seq) <= 1.25 * max(sum(tokens) / 128, sum(loss) / 60, len(tokens) / 5)
    with pytest.raises(ValueError):
        pack([200], [1], limits, cut=False)


def test_words_through_the_cache_are_the_library_s_ids():
    library, coder, rng = Tokenizer.from_file(PATH), WordTokenizer(PATH), random.Random(4)
    alphabet = ["The", "ING", "é", "é", "Σ", "ΑΣ", "İ", "ß", "'s", "'LL", "1", "²", " ", "  ", "\n", "\t", "\x1c", "\x85", " ",
                " ", "　", "!!", "<|endoftext|>", "<|", "日本", "😀", "́", "_", "|", "가", "ŉ", "Word", "İx", "café", "NAÏVE,", "end.", "(x)", "µ", "ª"]
    texts = ["", " "] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert list(array("I", ids)) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_query_over_nulls_and_long_texts(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "one two three", 0), (3, "one two three", 0), (4, "word " * 9000, 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = pack_documents(df, PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = {4: library.encode("word " * 9000, add_special_tokens=False).ids + [2], 1: [2], 2: [2]}
    for d, ids in want.items():
        pieces = sorted((r for r in got if r["doc_id"] == d), key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == len(ids)
        for r in pieces:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[r["start"] : r["start"] + r["length"]]).tobytes())
    assert pack_documents(df.limit(0), PATH).count() == 0


def loss_of(pieces, lead, loss):
    """Loss-bearing tokens of each sequence."""
    out = defaultdict(int)
    for p in pieces:
        lo, hi = lead[p.example], lead[p.example] + loss[p.example]
        out[p.sequence] += max(0, min(p.start + p.length, hi) - max(p.start, lo))
    return out


def test_every_limit_binds_when_examples_are_cut():
    rng = random.Random(5)
    tokens = [rng.randint(2, 400) for _ in range(300)] + [5000]
    loss = [rng.randint(0, t - 1) for t in tokens]
    lead = [rng.randint(0, t - x) for t, x in zip(tokens, loss)]
    free = pack(tokens, loss, Limits(1024, 512, 1024), lead=lead)
    assert max(loss_of(free, lead, loss).values()) > 300
    for limits in (Limits(1024, 6, 1024), Limits(1024, 512, 300), Limits(1024, 4, 200)):
        pieces = pack(tokens, loss, limits, lead=lead)
        check(pieces, tokens, limits)
        assert max(loss_of(pieces, lead, loss).values()) <= limits.loss_tokens
        assert pieces != free


def test_conversations_with_prompts_that_bear_no_loss(spark):
    turns = [r for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    rows = [(i, turns[i]["text"], turns[i + 1]["text"], "x") for i in range(0, len(turns) - 1, 2)] + [(9000, None, None, None), (9001, "word " * 600, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, prompt_text string, text string, prompt string").coalesce(1)
    library = Tokenizer.from_file(PATH)

    def ids(t):
        return library.encode(t or "", add_special_tokens=False).ids

    lead = {r[0]: len(ids(r[1])) for r in rows}
    loss = {r[0]: len(ids(r[2])) for r in rows}
    made = {}
    for limits in (Limits(512, 256, 512), Limits(512, 256, 128), Limits(512, 3, 512)):
        got = pack_documents(df, PATH, limits=limits, prompt="prompt_text").collect()
        by_seq, by_doc = defaultdict(list), defaultdict(list)
        for r in got:
            by_seq[r["sequence_id"]].append(r)
            by_doc[r["doc_id"]].append(r)
        for doc, before, text, _ in rows:
            whole, at = ids(before) + ids(text) + [2], 0
            for r in sorted(by_doc[doc], key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(array("I", whole[at : at + r["length"]]).tobytes())
                at += r["length"]
            assert at == len(whole)
        for part in by_seq.values():
            assert len(part) <= limits.segments and sum(r["length"] for r in part) <= limits.tokens
            bears = sum(max(0, min(r["start"] + r["length"], lead[r["doc_id"]] + loss[r["doc_id"]]) - max(r["start"], lead[r["doc_id"]])) for r in part)
            assert bears <= limits.loss_tokens
        made[limits] = len(by_seq)
    assert len(set(made.values())) == 3


def test_query_equals_the_library_on_whole_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    library, by_doc, by_seq = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in packing_query(spark, sf_dir).collect():
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = library.encode(text or "", add_special_tokens=False).ids + [2], 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(array("I", ids[at : at + r["length"]]).tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096 and at & (at - 1) == 0 and len(rows) <= Limits().segments
