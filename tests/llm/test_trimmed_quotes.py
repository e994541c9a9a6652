import random

from scatterlake.llm.quotes import RUN, link_quotes, runs

LONG = "The old mill stands by the river and its wheel has not turned\nsince the spring flood carried the upper gate away,\nso the miller's children moved to town."
SECOND = "Nobody has asked for the keys in all these years."
THIRD = "I still have them in a drawer."


def linked(spark, texts):
    rows = [(1, i, "user", t) for i, t in enumerate(texts)]
    got = link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    return {r["turn"]: (r["parent_turn"], r["n_quotes"], r["n_linked"], r["path"]) for r in got}


def quoted(*lines):
    return "\n".join("> " + x for x in lines) + "\nreply"


def test_parts_of_messages_are_linked(spark):
    texts = [
        f"{LONG}\n\n{SECOND}\n\n{THIRD}",
        "An answer about something else.\nThe river is high.",
        quoted(*LONG.split("\n")[:2]),  # two lines of three
        quoted(*LONG.split("\n"), "", SECOND),  # two paragraphs of three
        quoted("and its wheel has not turned since", "the spring flood carried the", "UPPER gate"),  # rewrapped, but for the ends
        quoted("The old mill stands", "[...]", "in a drawer."),  # left out between
        quoted("The old mill stands by ... its wheel has not turned"),
        quoted("The old mill stands by the lake and its wheel has not turned"),  # not what was said
        quoted("[...]"),
        quoted("An answer about something else.", "in a drawer."),  # two sources, none has both
    ]
    got = linked(spark, texts)
    for i in (2, 3, 4, 5, 6):
        assert got[i] == (0, 1, 1, [0, i]), i
    for i in (7, 8, 9):
        assert got[i][:3] == (None, 1, 0) and got[i][3] == [i], i


def test_source_is_the_latest_message_with_all_runs(spark):
    both = "alpha beta gamma\ndelta epsilon zeta\nmore"
    texts = [both, "x " + both, "so alpha beta gamma now", "so delta epsilon zeta now", "so alpha beta gamma again", quoted("alpha beta gamma", "delta epsilon zeta"), "y " + both]
    assert linked(spark, texts)[5][:3] == (1, 1, 1)


def test_against_brute_force(spark):
    rng = random.Random(8)
    bodies, texts = [], []
    for i in range(120):
        body, quote = [rng.choice("abcdef") for _ in range(rng.randint(3, 30))], []
        if bodies and rng.random() < 0.7:
            for _ in range(rng.randint(1, 3)):
                source = rng.choice(bodies)
                lo = rng.randrange(len(source))
                quote.append(" ".join(source[lo : lo + rng.randint(1, 14)]))
        texts.append("\n".join(["> " + x for x in quote] + [" ".join(body)]))
        bodies.append(body)
    got = linked(spark, texts)

    def holds(body, line):
        w = line.split()
        n = min(RUN, len(w))
        return all(any(body[k : k + n] == w[j : j + n] for k in range(len(body) - n + 1)) for j in range(len(w) - n + 1))

    some = 0
    for i, text in enumerate(texts):
        quote = [x[2:] for x in text.split("\n") if x.startswith("> ")]
        exact = [j for j in range(i) if " ".join(quote) == " ".join(bodies[j])]
        found = exact or [j for j in range(i) if all(holds(bodies[j], x) for x in quote)]
        assert got[i][0] == (found[-1] if quote and found else None), i
        some += bool(quote and found)
    assert some > 20


def test_runs():
    assert runs("") == [] and runs("... [...]") == []
    assert [n for n, _ in runs("a b ... c")] == [1, 2]
    assert len(runs(" ".join(map(str, range(20))))) == 20 - RUN + 1
