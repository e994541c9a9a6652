import math
import re
import unicodedata
from collections import Counter

from scatterlake.llm.quality import QualityConfig, common_words, features, keep_quality, quality_rules, references

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_counts_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(-1, None), (-2, ""), (-3, " \n\x0b\x0c\r\n"), (-4, "a a a a a a a a"), (-5, "x\x1cy z #|é É 日本\n\n日本\n日本 "), (-6, "a b c d e " * 4000),
           (-7, "😀    x")]
    extra = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "'xx' lang", "'s' source", "0L n_chars")
    both = docs.unionByName(extra)
    got = {r["doc_id"]: r for r in quality_rules(both).collect()}
    for r in both.collect():
        g, want = got[r["doc_id"]], counts(r["text"])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want, r["doc_id"]
        assert g["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (g["kept"] and g["base_failed"])


def character_class(c):
    kind = unicodedata.category(c)
    if WORD.fullmatch(c) is None:
        return "space"
    return "symbol" if c in "#*$%&|<>" else "upper" if kind == "Lu" else "digit" if kind == "Nd" else "punctuation" if kind[0] in "PS" else "rest"


def test_a_language_of_too_little_text_is_not_judged_by_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    greek = "".join(chr(0x3B1 + i % 20) + (" " if i % 5 == 4 else "") for i in range(800))
    words = " ".join(w + str(i) for i, w in enumerate(greek.split()))
    odd = [(-1, words, "el"), (-2, words, None), (-3, words, "en")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))).collect()}
    assert kept[-1] and not kept[-2] and not kept[-3]


def test_clashing_names_long_texts_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long, "en", "k", 1, 2, 3), (1, long, "en", "k", 1, 2, 3), (2, None, "en", "k", 1, 2, 3), (None, long, None, "k", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, `a``b` string, n_words int, doc_0 int, words int")
    assert {r["n_words"] for r in quality_rules(df).where("doc_id = 1").collect()} == {60_000}
    out = keep_quality(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted([rows[0], rows[1], rows[3]], key=str)


def js(p, q):
    return math.sqrt(max(0.0, sum((a * math.log2(2 * a / (a + b)) if a else 0) / 2 + (b * math.log2(2 * b / (a + b)) if b else 0) / 2 for a, b in zip(p, q))))


def test_distances_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    common = common_words(docs)
    tallies = {}
    for r in docs.collect():
        if r["lang"] is not None:
            tallies.setdefault(r["lang"], Counter()).update(WORD.findall(r["text"] or ""))
    top = {k: [w for w, _ in sorted(t.items(), key=lambda x: (-x[1], x[0])) if w.isalpha()][:10] for k, t in tallies.items() if sum(t.values()) >= 2000}
    assert common == top
    refs = references(features(docs, common), common)
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    listed = sorted({w for ws in common.values() for w in ws})
    config = QualityConfig()
    for r in docs.collect():
        words, text = WORD.findall(r["text"] or ""), r["text"] or ""
        if not words:
            continue
        kinds = Counter(character_class(c) for c in text)
        shares = [kinds[k] / len(text) for k in ("upper", "digit", "symbol", "punctuation", "space", "rest")]
        by_class = min(js(shares, x["classes"]) for x in refs.values())
        assert abs(by_class - got[r["doc_id"]]["js_class"]) < 1e-6
        tally = Counter(w for w in words if w in listed)
        p = [tally[w] / len(words) for w in listed] + [1 - sum(tally.values()) / len(words)]
        best = min(js(p, [x["words"].get(w, 0.0) for w in listed] + [x["other"]]) for x in refs.values())
        assert abs(best - got[r["doc_id"]]["js_words"]) < 1e-6
        root = math.sqrt(len(words))
        far = by_class > config.max_class_distance + config.class_allowance / root or best > config.max_word_distance + config.word_allowance / root
        judged = len(text) >= config.guard_chars and len(words) >= config.guard_words and (r["lang"] is None or r["lang"] in refs)
        assert got[r["doc_id"]]["kept"] == (not got[r["doc_id"]]["base_failed"] and not (judged and far))


def test_labels_and_planted_junk(spark):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = quality_rules(docs).join(labels, "doc_id").collect()
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean)
    junk = [r for r in rows if r["quality"] == 0]
    assert sum(not r["kept"] for r in junk) >= 0.7 * len(junk)


def test_empty_table_and_no_reference(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, kept string")
    assert quality_rules(df).count() == 0
    one = spark.createDataFrame([(1, "THE END !! " * 100, "zz"), (2, " ".join("abcdefghijkl"), None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules(one, QualityConfig()).collect()}
    assert got[2]["kept"] and got[2]["js_class"] is None and not got[1]["kept"]
