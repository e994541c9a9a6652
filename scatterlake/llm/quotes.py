"""Chat formatting by quotation linking.

A message's lines are parsed into its own text (level 0) and quoted blocks of
nested levels (``>`` marks). A block is normalised and hashed, and joined to the
message of the same conversation that said it: the latest earlier one with that
passage (its whole own text, one of its paragraphs, or one of its lines). A block
that nobody said in that form is a trimmed or rewrapped quote: its lines, split at
marks of omission, are cut into runs of up to ``RUN`` words, and it is joined to
the latest earlier message that holds all of these runs. The
source of the first linked block is the message's parent; replies are ordered by
their path from the root, and leave the quotes out.

The join is one running window per (conversation, passage), linear in the
messages, so repeated passages make no pairs and a conversation of any size is
spread over its passages. For several runs it is repeated from the least of their
sources until these agree, which is the latest message that holds them all. Paths are built by pointer doubling, in as many rounds
as the logarithm of the deepest thread, each written to the shared folder.

Defined cases: null text is empty; a message without conversation or turn links
with nothing and is a root; rows that share conversation and turn keep a row
each and share their parent (the least found); a quote of what nobody said
earlier stays unlinked, and so does one of marks of omission only; quotes never reach into other conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, small_batches

_MARK = re.compile(r"[ \t]{0,3}>")
#: A line that announces a quote, such as "On Monday Ann wrote:".
_ANNOUNCE = re.compile(r"^\s*(on\b.*\b(wrote|said)|\S.{0,80}\b(wrote|said))\s*:\s*$", re.IGNORECASE)
#: A word that stands for what a quote leaves out.
_OMITTED = re.compile(r"[\[(<]*(\.{3,}|\u2026|snip)[\])>]*$")
#: Most words of one run of a trimmed quote; longer lines are all their runs of so many words.
RUN = 8
MAX_ROUNDS = 40


def quote_level(line: str) -> tuple[int, str]:
    """Number of leading quote marks, and what follows them."""
    level = 0
    while m := _MARK.match(line):
        level, line = level + 1, line[m.end() :]
    return level, line[1:] if level and line[:1] == " " else line


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted blocks (level, text) in order.

    A block of a level is a run of lines of at least that level; the lines of
    deeper levels inside it are blocks of their own and not part of it.
    """
    lines = [quote_level(x) for x in text.split("\n")]
    own = [
        x for i, (level, x) in enumerate(lines)
        if level == 0 and not (i + 1 < len(lines) and lines[i + 1][0] > 0 and _ANNOUNCE.match(x))
    ]
    blocks, open_ = [], []
    for level, x in lines:
        while len(open_) > level:
            open_.pop()
        while len(open_) < level:
            blocks.append((len(open_) + 1, []))
            open_.append(blocks[-1][1])
        if level:
            open_[-1].append(x)
    found = [(level, "\n".join(x for x in part if not _ANNOUNCE.match(x))) for level, part in blocks]
    return "\n".join(own).strip("\n"), [(level, x) for level, x in found if x.strip()]


def normalise(passage: str) -> str:
    return " ".join(passage.casefold().split())


def _hash(passage: str) -> bytes:
    return hashlib.blake2b(normalise(passage).encode(), digest_size=16).digest()


def passages(own: str) -> list[bytes]:
    """Hashes under which a message's own text can be quoted: whole, by paragraph, by line."""
    parts = [own, *re.split(r"\n\s*\n", own), *own.split("\n")]
    return sorted({_hash(x) for x in parts if x.strip()})


def runs(block: str) -> list[tuple[int, bytes]]:
    """Runs of words (their number, hash) that a message must hold to be the source of a trimmed block."""
    out = set()
    for line in block.split("\n"):
        parts = [[]]
        for word in line.casefold().split():
            if _OMITTED.match(word):
                parts.append([])
            else:
                parts[-1].append(word)
        for words in parts:
            size = min(RUN, len(words))
            out.update((size, _hash(" ".join(words[i : i + size]))) for i in range(len(words) - size + 1) if size)
    return sorted(out)


def parsed(messages: DataFrame) -> DataFrame:
    small_batches(messages.sparkSession)
    block = pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("runs", pa.list_(pa.struct([("size", pa.int32()), ("run", pa.binary())])))])

    def run(batches):
        for batch in batches:
            out = [parse(t or "") for t in batch.column("text").to_pylist()]
            for name, cols in (
                ("body", pa.array([own for own, _ in out], pa.string())),
                ("quotes", pa.array([[_block(level, x) for level, x in q] for _, q in out], pa.list_(block))),
                ("said", pa.array([passages(own) for own, _ in out], pa.list_(pa.binary()))),
            ):
                batch = batch.append_column(name, cols)
            yield batch.drop_columns(["text"])

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    return rows.mapInArrow(
        run, "conv_id long, turn long, role string, body string, quotes array<struct<level:int,hash:binary,runs:array<struct<size:int,run:binary>>>>, said array<binary>"
    )


def _block(level: int, text: str) -> dict:
    return {"level": level, "hash": _hash(text), "runs": [{"size": size, "run": run} for size, run in runs(text)]}


def _held(placed: DataFrame, asked: DataFrame) -> DataFrame:
    """(conv_id, turn, run) of the asked runs that stand anywhere in a message's own text."""
    sizes = asked.groupBy("conv_id").agg(F.array_sort(F.collect_set("size")).alias("sizes"))  # at most RUN of them

    def run(batches):
        for batch in batches:
            conv, turn, found = [], [], []
            for c, t, body, lengths in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "body", "sizes")), strict=True):
                words = body.casefold().split()
                hashes = {_hash(" ".join(words[i : i + n])) for n in lengths for i in range(len(words) - n + 1)}
                conv += [c] * len(hashes)
                turn += [t] * len(hashes)
                found += hashes
            yield pa.record_batch({"conv_id": pa.array(conv, pa.int64()), "turn": pa.array(turn, pa.int64()), "run": pa.array(found, pa.binary())})

    every = placed.select("conv_id", "turn", "body").join(sizes, "conv_id").mapInArrow(run, "conv_id long, turn long, run binary")
    return every.join(asked.select("conv_id", "run").distinct(), ["conv_id", "run"], "left_semi").distinct()


def trimmed_links(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """conv_id, turn, at, source of blocks (conv_id, turn, at, hash, runs) of which an earlier message holds all runs."""
    block = ["conv_id", "turn", "at", "hash"]
    asked = blocks.select(*block, F.explode("runs").alias("r")).select(*block, F.col("r.size").alias("size"), F.col("r.run").alias("run")).distinct()
    held = materialize(_held(placed, asked), "quote-runs")
    held = held.select("conv_id", "run", F.col("turn").alias("before"), F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(x) for x, t in (("turn", "long"), ("at", "int"), ("hash", "binary"))))
    # at equal turns questions come first: a source lies before the turn asked for
    running = Window.partitionBy("conv_id", "run").orderBy("before", "kind").rowsBetween(Window.unboundedPreceding, 0)
    source = F.last(F.when(F.col("kind") == 1, F.col("before")), ignorenulls=True).over(running)
    open_, links = asked.select(*block, "run", F.col("turn").alias("before"), F.lit(0).alias("kind")), None
    while True:
        each = held.unionByName(open_).withColumn("source", source).where("kind = 0")
        low = each.groupBy(*block).agg(F.min("source").alias("low"), F.max("source").alias("high"), F.count(F.lit(1)).alias("n"), F.count("source").alias("found"))
        low = materialize(low.where("n = found").drop("n", "found"), "quote-links")
        done = low.where("low = high").select("conv_id", "turn", "at", F.col("low").alias("source"))
        links = done if links is None else materialize(links.unionByName(done), "quote-links")
        rest = low.where("low < high").select(*block, (F.col("low") + 1).alias("before"), F.lit(0).alias("kind"))
        if rest.isEmpty():
            return links
        open_ = asked.select(*block, "run").join(rest, block)


def _paths(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, path, depth) of messages with a parent; a path is the turns from the root down."""
    at = parents.select("conv_id", "turn", F.col("parent").alias("up"), F.array("turn").alias("path"))
    at = materialize(at, "threads")
    for _ in range(MAX_ROUNDS):
        above = at.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("path").alias("head"))
        hop = at.join(above, (at["conv_id"] == above["c"]) & (at["up"] == above["t"]), "left")
        hop = materialize(
            hop.select(
                "conv_id", "turn",
                F.when(F.col("t").isNull(), F.col("up")).otherwise(F.col("up2")).alias("up"),
                F.when(F.col("t").isNull(), F.col("path")).otherwise(F.concat("head", "path")).alias("path"),
                F.col("t").isNotNull().alias("moved"),
            ),
            "threads",
        )
        moved = not hop.where("moved").isEmpty()
        at = hop.drop("moved")
        if not moved:
            break
    else:
        raise RuntimeError("threads did not settle")  # a thread of 2**40 replies
    return at.select("conv_id", "turn", F.concat(F.array("up"), "path").alias("path"), F.size("path").alias("depth"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, n_linked, parent_turn, depth and path per message.

    Ordering a conversation by ``path`` puts every reply behind its parent.
    """
    rows = materialize(parsed(messages), "messages")
    placed = rows.where("conv_id is not null and turn is not null")
    said = placed.select("conv_id", "turn", F.explode("said").alias("hash")).distinct()
    said = said.select("conv_id", "hash", "turn", F.lit(1).alias("kind"), F.lit(0).alias("at"))
    asked = placed.select("conv_id", "turn", F.posexplode("quotes").alias("at", "q"))
    blocks = asked.select("conv_id", "turn", "at", F.col("q.hash").alias("hash"), F.col("q.runs").alias("runs"))
    asked = blocks.select("conv_id", "hash", "turn", F.lit(0).alias("kind"), "at")
    # at equal turns questions come first, so that a message is never its own source
    running = Window.partitionBy("conv_id", "hash").orderBy("turn", "kind").rowsBetween(Window.unboundedPreceding, 0)
    quoted = asked.select("conv_id", "hash").distinct()
    both = said.join(quoted, ["conv_id", "hash"], "left_semi").unionByName(asked)
    source = F.last(F.when(F.col("kind") == 1, F.col("turn")), ignorenulls=True).over(running)
    linked = both.withColumn("source", source).where("kind = 0 and source is not null")
    linked = materialize(linked.select("conv_id", "turn", "at", "hash", "source"), "quote-hits")
    trimmed = blocks.where(F.size("runs") > 0).join(linked, ["conv_id", "turn", "at", "hash"], "left_anti")
    if not trimmed.isEmpty():
        linked = linked.drop("hash").unionByName(trimmed_links(placed, trimmed))
    links = linked.groupBy("conv_id", "turn").agg(
        F.count_distinct("at").cast("long").alias("n_linked"), F.min(F.struct("at", "source"))["source"].alias("parent")
    )
    links = materialize(links, "quote-links")
    paths = _paths(links) if not links.isEmpty() else links.select("conv_id", "turn", F.array("turn").alias("path"), F.lit(0).alias("depth"))
    found = links.join(paths, ["conv_id", "turn"], "left")
    out = rows.join(found, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "body",
        F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.coalesce("path", F.array("turn")).alias("path"),
    )


def quotes_query(spark, sf_dir: str) -> DataFrame:
    rows = link_quotes(read_table(spark, sf_dir, "conversations"))
    path = F.array_join(F.transform("path", lambda t: F.lpad(t.cast("string"), 12, "0")), ".")
    return rows.select(
        "conv_id", "turn", "role", "n_quotes", "n_linked", "parent_turn", "depth", path.alias("reply_path"),
        F.length("body").cast("long").alias("body_chars"), F.sha2("body", 256).alias("body_sha256"),
    )
