from scatterlake.llm.quotes import link_quotes, parse, quote_level


def test_levels_and_blocks():
    assert quote_level("> > a") == (2, "a") and quote_level(">> a") == (2, "a") and quote_level("a > b") == (0, "a > b")
    own, blocks = parse("Hi\nOn Monday Ann wrote:\n> one\n>> two\n> three\nme")
    assert own == "Hi\nme" and blocks == [(1, "one\nthree"), (2, "two")]
    assert parse("") == ("", []) and parse(">\n> ") == ("", [])


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path int, said string")


def test_threads_are_linked_and_ordered(spark):
    rows = [
        (1, 0, "user", "How does it work?\n\nAnd why?", 0, ""),
        (1, 1, "assistant", "It just does.", 0, ""),
        (1, 2, "user", "> it  just DOES.\nReally?", 0, ""),
        (1, 3, "assistant", "> And why?\nBecause.", 0, ""),
        (1, 4, "user", "> > it just does.\n> Really?\nSo be it", 0, ""),
        (1, 5, "user", "> nobody said this\nHm", 0, ""),
        (2, 0, "user", "> It just does.", 0, ""),
        (None, 0, "user", "> Because.", 0, ""),
        (1, None, "user", "Because.", 0, ""),
        (3, 0, "user", None, 0, ""),
        (3, 1, "user", "again", 0, ""),
        (3, 2, "user", "again", 0, ""),
        (3, 3, "user", "> again", 0, ""),
        (3, 3, "user", "> again", 0, ""),
    ]
    got = {}
    for r in link_quotes(table(spark, rows)).collect():
        got.setdefault((r["conv_id"], r["turn"]), []).append(r)
    one = {k: v[0] for k, v in got.items()}
    assert one[1, 2]["parent_turn"] == 1 and one[1, 2]["body"] == "Really?"
    assert one[1, 3]["parent_turn"] == 0
    # the first block of a nested quote is the outer one: its source is turn 2
    assert one[1, 4]["parent_turn"] == 2 and one[1, 4]["path"] == [1, 2, 4] and one[1, 4]["depth"] == 2 and one[1, 4]["n_linked"] == 2
    assert one[1, 5]["n_quotes"] == 1 and one[1, 5]["n_linked"] == 0 and one[1, 5]["path"] == [5]
    assert one[2, 0]["n_linked"] == 0 and one[None, 0]["n_linked"] == 0
    assert one[3, 0]["body"] == "" and one[3, 3]["parent_turn"] == 2 and len(got[3, 3]) == 2
    assert sum(map(len, got.values())) == len(rows)


def test_long_threads_and_empty_tables(spark):
    n = 70
    rows = [(9, 0, "user", "message number 0", 0, "")]
    rows += [(9, i, "user", f"> message number {i - 1}\nmessage number {i}", 0, "") for i in range(1, n)]
    got = {r["turn"]: r for r in link_quotes(table(spark, rows)).collect()}
    assert got[n - 1]["path"] == list(range(n)) and got[n - 1]["depth"] == n - 1
    assert link_quotes(table(spark, [])).count() == 0


def test_query_over_the_table(spark, sf_dir):
    from scatterlake.llm.quotes import quotes_query

    assert quotes_query(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").count()
