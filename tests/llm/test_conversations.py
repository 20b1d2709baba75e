import random
import re
from collections import Counter

from lakemill.llm import quotation, ranking

SCHEMA = "conv_id long, turn long, role string, text string, position string, up int"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, "user", x, "p", 1) for c, t, x in rows], SCHEMA)


def quoted(text, level=1):
    return "\n".join("> " * level + line for line in text.split("\n"))


def test_parse_levels_and_introductions():
    own, passages = quotation.parse("Hi\nOn Monday A. wrote:\n> one\n> two\n> > deep\n>> deeper\n>\n> back\nAnswer\n\nEnd")
    assert own == "Hi\nAnswer\n\nEnd"
    assert passages == [(1, ["one", "two"]), (2, ["deep", "deeper"]), (1, ["", "back"])]
    assert quotation.parse(f"Hi\nOn Monday A. wrote {'and wrote ' * 30}: \n> one")[0] == "Hi" and quotation.parse("Hi\nOn Monday A. wrote\n> one")[0] == "Hi\nOn Monday A. wrote"
    assert quotation.parse("a > b\n  c ") == ("a > b\n  c ", []) and quotation.parse("") == ("", [])


def brute(rows):
    """What link() says, by search over all messages."""
    parsed = {(c, t): quotation.parse(x or "") for c, t, x in rows}
    says = {n: set(quotation.units(own)) for n, (own, _) in parsed.items()}
    up = {}
    for n, (_, passages) in parsed.items():
        found = []
        for place, (level, lines) in enumerate(passages):
            whole = "\n".join(lines)
            paragraphs = [p for p in re.split(r"\n[ \t]*\n", whole) if p != whole and "\n" in p.strip()]
            for part, p in [(0, whole), *((1, p) for p in paragraphs), *((2, p) for p in lines if len(lines) > 1)]:
                key = quotation.key_of(p)
                near = [m for m in says if key in says[m] and m[0] == n[0] and m[1] < n[1]] if key else []
                first = min((m for m in says if key in says[m]), default=None) if key else None
                alone = len({m[0] for m in says if key in says[m]}) == 1
                source = max(near) if near else first if first and first[0] < n[0] and alone else None
                if source:
                    found.append((level, part, place, source))
        if found:
            up[n] = min(found)[3]
    out = {}
    for n in parsed:
        depth, top = 0, n
        while top in up:
            depth, top = depth + 1, up[top]
        out[n] = (up.get(n), depth, top[0])
    return out


def wrapped(text, width):
    """Each paragraph of a text quoted in lines of ``width`` words."""
    paragraphs = [p.replace("\n", " ").split(" ") for p in text.split("\n\n")]
    return "\n>\n".join("\n".join("> " + " ".join(w[i : i + width]) for i in range(0, len(w), width)) for w in paragraphs)


def threads():
    r = random.Random(8)
    rows = []
    for c in range(20, 32):
        # paragraphs that are quoted in part, in lines of another width, under long introductions
        said = []
        for t in range(r.randrange(4, 14)):
            own = [f"paragraph {i} of {c} {t} " + " ".join(f"w{r.randrange(9)}" for _ in range(r.randrange(5, 14))) for i in range(r.randrange(1, 4))] + r.choice([[], ["with all\nmy thanks"]])
            text = "\n\n".join(own)
            if said:
                old = r.choice(said)
                some = "\n\n".join(p for p in old.split("\n\n") if r.random() < 0.8) or old
                lead = r.choice(["", f"On Monday {'x' * 90} wrote {'to us all ' * 9}:\n", "On Monday you wrote\n"])
                text = f"{lead}{wrapped(some, r.randrange(3, 8))}\n{r.choice(['', '> with all> my thanks'])}\n{text}"
            rows.append((c, t, text))
            said.append("\n\n".join(own))
    for c in range(12):
        said = []
        for t in range(r.randrange(1, 25)):
            parts = [f"hello {r.randrange(6)} from {r.randrange(40)}\nline {c} {t}", "thanks", f"only {c} {t} here"]
            text = r.choice(parts)
            if said and r.random() < 0.7:
                old = r.choice(said)
                text = f"{quoted(old.split(chr(10))[0] if r.random() < 0.4 else old)}\n{text}"
            if r.random() < 0.3:
                text = f"{quoted('hello 1 from 2', r.randrange(1, 3))}\n{text}\n{quoted('nobody said this')}"
            rows.append((c, t, text))
            said.append(quotation.parse(text)[0])
    return rows


def test_links_equal_brute_force(spark):
    rows = threads()
    want, got = brute(rows), quotation.link(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows) and sum(w[0] is not None for w in want.values()) > 40 and max(w[1] for w in want.values()) > 3
    for r in got:
        reply = (r.reply_conv, r.reply_turn) if r.reply_turn is not None else None
        assert (reply, r.depth, r.thread_conv) == want[r.conv_id, r.turn]
    place = {(r.conv_id, r.turn): (r.thread_conv, r.position) for r in got}
    for r in got:
        if r.reply_turn is not None:
            above, own = place[r.reply_conv, r.reply_turn], place[r.conv_id, r.turn]
            assert above[0] == own[0] and above[1] < own[1]
        assert not re.search(r"^[ \t]*>", r.text, re.MULTILINE)
    for thread in {r.thread_conv for r in got}:
        assert sorted(r.position for r in got if r.thread_conv == thread) == list(range(sum(r.thread_conv == thread for r in got)))


def test_nulls_repeats_and_nothing(spark):
    rows = [(1, 0, "a b"), (1, 0, "a b"), (1, 1, "> a b\nyes"), (1, 1, None), (None, 2, "> a b"), (1, None, "> a b"), (2, 5, ""), (2, 6, "> \n>"), (2, 7, "> A, B!\n" + "x " * 50_000)]
    df = frame(spark, rows)
    got = quotation.link(df).collect()
    assert len(got) == len(rows)
    links = Counter((r.conv_id, r.turn, r.reply_conv, r.reply_turn, r.text is None) for r in got)
    assert links == {(1, 0, None, None, False): 2, (1, 1, 1, 0, False): 1, (1, 1, 1, 0, True): 1, (None, 2, None, None, False): 1, (1, None, None, None, False): 1, (2, 5, None, None, False): 1, (2, 6, None, None, False): 1, (2, 7, 1, 0, False): 1}
    assert quotation.link(df.limit(0)).count() == 0


def test_a_long_chain_of_replies(spark):
    rows = [(1, 0, "m 0")] + [(1, t, f"> m {t - 1}\nm {t}") for t in range(1, 70)]
    got = {r.turn: r for r in quotation.link(frame(spark, rows)).collect()}
    assert all(got[t].depth == t and got[t].position == t and got[t].text == f"m {t}" for t in range(70))


def test_trimmed_and_wrapped_quotes_of_several_paragraphs(spark):
    first, second, third = (" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma"))

    def wrapped(text):
        words = text.split(" ")
        return "\n".join("> " + " ".join(words[i : i + 7]) for i in range(0, len(words), 7))

    rows = [
        (1, 0, "thanks\n\nbye"), (1, 1, f"{first}\n\n{second}\n\n{third}"), (1, 2, f"{wrapped(first)}\n>\n{wrapped(second)}\nYes"),
        # a paragraph says more than a line that others have said too
        (1, 3, f"> thanks\n> \t\n{wrapped(third)}\nNo"), (2, 0, f"{wrapped(second)}\n>\n{wrapped(third)}\n>> {first}\nElsewhere"), (2, 1, f"{wrapped('nobody said this at all or ever')}\n>\n{wrapped('nor was this said before by any of us')}\nNew"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotation.link(frame(spark, rows)).collect()}
    assert [(got[n].reply_conv, got[n].reply_turn, got[n].depth, got[n].text) for n in ((1, 2), (1, 3), (2, 0))] == [(1, 1, 1, "Yes"), (1, 1, 1, "No"), (1, 1, 1, "Elsewhere")]
    assert got[2, 1].reply_turn is None and got[2, 0].thread_conv == 1


def test_a_line_that_all_conversations_say_joins_none(spark):
    rows = [(c, t, ["thanks", "> thanks\nwelcome"][t]) for c in range(60) for t in range(2)]
    rows += [(c, 0, f"> thanks\n> only {c % 7} said this\nand more") for c in range(100, 140)] + [(c, 0, f"only {c} said this") for c in range(60, 67)]
    rows += [(c, 1, f"> only {c - 200 + 60} said this\nyes") for c in range(200, 207)]
    got = {(r.conv_id, r.turn): r for r in quotation.link(frame(spark, rows)).collect()}
    assert all((got[c, 1].reply_conv, got[c, 1].thread_conv, got[c, 1].n_common) == (c, c, 0) for c in range(60))
    assert all((got[c, 0].reply_turn, got[c, 0].thread_conv, got[c, 0].n_common) == (None, c, 1) for c in range(100, 140))
    assert all((got[c, 1].reply_conv, got[c, 1].thread_conv, got[c, 1].n_common) == (c - 140, c - 140, 0) for c in range(200, 207))


def test_a_conversation_that_repeats_a_line_is_cut_into_buckets(spark, monkeypatch):
    monkeypatch.setattr(quotation, "BUCKET_TURNS", 4)
    says = {3, 4, 17, 29}
    rows = [(1, t, "the line" if t in says else "> the line\nagain" if t % 3 else f"other {t}") for t in range(45)]
    got = {r.turn: r for r in quotation.link(frame(spark, rows).repartition(5)).collect()}
    for _, t, text in rows:
        before = [s for s in says if s < t]
        assert got[t].reply_turn == (max(before) if before and text.startswith(">") else None) and got[t].position == t


def test_ranks_of_ties_and_hot_groups(spark):
    rows = [("hot", 5, i) for i in range(400)] + [("a", i % 7, 1000 + i) for i in range(50)] + [(None, None, 2000 + i) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, t long, row long").repartition(6)
    got = ranking.sort_ranked(df, ["g"], ["t", "row"], "rank").collect()
    for g in ("hot", "a", None):
        assert [r.rank for r in sorted((r for r in got if r.g == g), key=lambda r: (r.t or 0, r.row))] == list(range(sum(x[0] == g for x in rows)))
