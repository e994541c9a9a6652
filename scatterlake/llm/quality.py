"""Quality rules: divergence of a document from what its language looks like.

Base rules fail very short texts and texts made of repeated five-word windows.
The others are compared with language references by the Jensen-Shannon distance
(base 2, 0 to 1) of two histograms: character classes, and common words with one
bucket for all other words. Common words are learned: the most frequent ones of
every language with enough text. References are sums over all documents of the
language that pass the base rules. A document is rejected if even its nearest
reference is too far; texts shorter than the guards are not judged by
histograms, and the limits widen for short texts, since short samples diverge by chance.

Everything is DataFrame expressions: no Python runs on the executors. A document's features are
computed once and written to the shared folder; the references are a few rows per
language, and become literals of the last pass.

Defined cases: null text has no words and fails the base rules; very long texts
are judged whole; repeated rows are judged each; documents without a language
build no reference but are judged against all; documents of a language with too
little text for a reference are judged by the base rules only, as are all where
there is no reference; more than ``max_langs`` references raise ``ValueError``; a
null id is carried through; other columns are ignored, or kept as they are by
:func:`keep_quality`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, read_table

BREAK = r"[\x20\x09-\x0D]+"
#: Character classes counted by removal; white space and the rest (letters of no case but lower) follow.
CLASSES = {"upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "symbol": r"[#*$%&|<>]+", "punctuation": r"[\p{P}\p{S}&&[^#*$%&|<>]]+"}


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: Texts with fewer characters or words are not judged by histograms.
    guard_chars: int = 200
    guard_words: int = 60
    #: A limit is a floor plus an allowance for sampling, over the root of the number of words.
    max_class_distance: float = 0.10
    class_allowance: float = 1.6
    max_word_distance: float = 0.21
    word_allowance: float = 1.0
    #: Common words of a language, and the words that it must have for a reference.
    common: int = 10
    reference_words: int = 2000
    max_langs: int = 200


def repeat_words(words: Column, size: int) -> Column:
    """Number of words that lie in windows of ``size`` words found twice or more."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(hashed)

    def windows(h):
        return F.transform(
            F.slice(h, F.lit(1), F.greatest(n - (size - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[h[i + k] for k in range(1, size)]),
        )

    def covered(win):
        ranked = F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(pairs):
            last = F.size(pairs) - 1
            twice = F.filter(
                pairs,
                lambda x, j: ((j > 0) & (F.get(pairs, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(pairs, j + 1)["h"] == x["h"])),
            )
            at = F.array_sort(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("end"))
            # each window adds the words behind the end of the one before it
            return F.aggregate(
                at,
                start,
                lambda acc, i: F.struct(
                    (acc["n"] + size - F.greatest(F.lit(0), acc["end"] - i)).alias("n"), (i + size).alias("end")
                ),
                lambda acc: acc["n"],
            )

        return _let(ranked, count)

    return _let(hashed, lambda h: _let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))))


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BREAK), lambda w: w != "")


def common_words(docs: DataFrame, config: QualityConfig = QualityConfig()) -> dict[str, list[str]]:
    """The most frequent words (of letters) of every language with enough text, over all documents."""
    if "lang" not in docs.columns:
        return {}
    rows = docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.explode(_words(F.coalesce("text", F.lit("")))).alias("w"))
    counts = rows.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, config.reference_words // 100))
    # each task keeps its first words of a language before they are shuffled
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    top = counts.where(F.col("w").rlike(r"^\p{L}+$")).withColumn("rank", rank).where(F.col("rank") <= config.common)
    found: dict[str, list[str]] = {}
    for r in sorted(top.limit(config.common * (config.max_langs + 1)).collect(), key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(r["w"])
    if len(found) > config.max_langs:
        raise ValueError(f"more than {config.max_langs} languages")
    return found


def features(docs: DataFrame, common: dict[str, list[str]], config: QualityConfig = QualityConfig(), carry: str | None = None) -> DataFrame:
    """doc_id, lang, the base counts, class counts and common-word counts of each row.

    With ``carry`` the column of that name comes along.
    """
    carried = [carry] if carry else []
    listed = sorted({w for words in common.values() for w in words})
    text = F.coalesce("text", F.lit(""))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), text.alias("text"), *carried)
    df = df.withColumn("words", _words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    removed = {k: (F.length("text") - F.length(F.regexp_replace("text", p, ""))).cast("long") for k, p in CLASSES.items()}
    n_chars = F.length("text").cast("long")
    df = df.select(
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        removed["symbol"].alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), config.window).cast("long").alias("n_repeat_words"),
        n_chars.alias("n_chars"),
        removed["upper"].alias("upper"),
        removed["digit"].alias("digit"),
        removed["punctuation"].alias("punctuation"),
        _let(
            F.filter("words", lambda w: w.isin(listed) if listed else F.lit(False)),
            lambda m: F.transform(
                F.array_distinct(m), lambda w: F.struct(w.alias("w"), (F.size(m) - F.size(F.array_remove(m, w))).cast("long").alias("n"))
            ),
        ).alias("common"),
        *carried,
    )
    failed = (F.col("n_words") < config.min_words) | (100 * F.col("n_repeat_words") > config.max_repeat_percent * F.col("n_words"))
    return df.withColumn("base_failed", failed)


CLASS_COLUMNS = ["upper", "digit", "n_symbols", "punctuation", "space", "rest"]


def _with_rest(df: DataFrame) -> DataFrame:
    space = F.col("n_chars") - F.col("word_chars")
    rest = F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("n_symbols") - F.col("punctuation")
    return df.withColumns({"space": space, "rest": rest})


def references(rows: DataFrame, common: dict[str, list[str]], config: QualityConfig = QualityConfig()) -> dict[str, dict]:
    """Class shares and common-word shares of every reference language (a few rows)."""
    good = _with_rest(rows.where(~F.col("base_failed")).where(F.col("lang").isin(sorted(common)) if common else F.lit(False)))
    sums = good.groupBy("lang").agg(F.sum("n_words").alias("n_words"), *[F.sum(c).alias(c) for c in CLASS_COLUMNS]).collect()
    words = good.select("lang", F.explode("common").alias("c")).groupBy("lang", "c.w").agg(F.sum("c.n").alias("n")).collect()
    out = {}
    for r in sorted((r for r in sums if r["n_words"] >= config.reference_words), key=lambda r: r["lang"]):
        total = sum(r[c] for c in CLASS_COLUMNS)
        own = {x["w"]: x["n"] / r["n_words"] for x in words if x["lang"] == r["lang"]}
        out[r["lang"]] = {"classes": [r[c] / total for c in CLASS_COLUMNS], "words": own, "other": 1.0 - sum(own.values())}
    return out


def _term(p: Column, q: Column) -> Column:
    """One bucket's part of the Jensen-Shannon divergence."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2


def class_distance(shares: Column) -> Column:
    total = F.greatest(F.col("n_chars"), F.lit(1))
    parts = [_term(F.col(c) / total, shares[i]) for i, c in enumerate(CLASS_COLUMNS)]
    return F.sqrt(F.greatest(sum(parts[1:], parts[0]), F.lit(0.0)))


def word_distance(words: Column, listed: Column, other: Column) -> Column:
    """To a reference's shares of ``words``; buckets the document lacks add half their reference share, as a whole."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")

    def add(acc, x):
        q = F.coalesce(F.try_element_at(words, x["w"]), F.lit(0.0))
        return F.struct((acc["d"] + _term(x["n"] / n, q)).alias("d"), (acc["q"] + q).alias("q"), (acc["n"] + x["n"]).alias("n"))

    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        "common",
        zero,
        add,
        lambda acc: F.sqrt(F.greatest(acc["d"] + F.greatest(listed - acc["q"], F.lit(0.0)) / 2 + _term(1 - acc["n"] / n, other), F.lit(0.0))),
    )


def _literals(refs: dict[str, dict]) -> Column:
    rows = []
    for r in refs.values():
        words = r["words"] or {"": 0.0}
        rows.append(F.struct(
            F.array(*[F.lit(float(q)) for q in r["classes"]]).alias("classes"),
            F.create_map(*[F.lit(x) for w in sorted(words) for x in (w, float(words[w]))]).alias("words"),
            F.lit(float(sum(words.values()))).alias("listed"), F.lit(float(r["other"])).alias("other"),
        ))
    return F.array(*rows)


def judge(rows: DataFrame, refs: dict[str, dict], config: QualityConfig = QualityConfig(), carry: str | None = None) -> DataFrame:
    """The counts with js_class, js_words (to the nearest reference; null without one) and kept."""
    df = _with_rest(rows)
    if refs:
        table = _literals(refs)
        df = df.withColumns({
            "js_class": F.array_min(F.transform(table, lambda r: class_distance(r["classes"]))),
            "js_words": F.array_min(F.transform(table, lambda r: word_distance(r["words"], r["listed"], r["other"]))),
        })
    else:
        df = df.withColumns({"js_class": F.lit(None).cast("double"), "js_words": F.lit(None).cast("double")})
    root = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    judged = (F.col("n_chars") >= config.guard_chars) & (F.col("n_words") >= config.guard_words)
    judged = judged & (F.col("lang").isNull() | F.col("lang").isin(sorted(refs))) if refs else F.lit(False)
    strange = F.col("js_class") > config.max_class_distance + config.class_allowance / root
    strange = judged & (strange | (F.col("js_words") > config.max_word_distance + config.word_allowance / root))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return df.select(*counts, (~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))).alias("kept"), "js_class", "js_words", *([carry] if carry else []))


def quality_rules(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    common = common_words(docs, config)
    rows = materialize(features(docs, common, config), "quality")
    return judge(rows, references(rows, common, config), config)


def keep_quality(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    The verdict depends on text and language only and is kept by a digest of both, so
    the counts that are written, and stay for the lazy result, hold no texts. The digest
    also covers the id, else all copies of a text would meet in one task.
    """
    name, common = fresh(docs.columns, "key"), common_words(docs, config)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    parts = [F.md5(F.coalesce(x.cast("string"), F.lit("")).cast("binary")) for x in (F.col("text"), F.col("doc_id"))]
    keyed = docs.withColumn(name, F.unhex(F.md5(F.concat(*parts, F.coalesce(F.concat(F.lit("="), lang), F.lit(""))).cast("binary"))))
    rows = materialize(features(keyed, common, config, name), "quality")
    kept = judge(rows, references(rows, common, config), config, name).where("kept").select(name)
    return keyed.join(kept, name, "left_semi").select(*[_column(c) for c in docs.columns])


def quality_query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
