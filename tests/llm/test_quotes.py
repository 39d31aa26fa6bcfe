"""Quotation linking beside brute force, over planted conversations."""

import random

import pytest

from nestplane.llm import joins, quotes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def wrapped(r, text, marks):
    """The text quoted with other line breaks and punctuation."""
    words, out = text.split(), []
    while words:
        n = r.randrange(2, 9)
        out.append(marks + " " + " ".join(words[:n]).upper() + r.choice(["", ".", " !"]))
        words = words[n:]
    return "\n".join(out)


def planted(seed, conversations=6, turns=14):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for c in range(conversations):
        texts = []
        for t in range(turns):
            own = " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 8, 25])))
            if t and r.random() < 0.2:
                own = r.choice(texts)  # the same words again
            parts = [own]
            if t and r.random() < 0.7:
                parts.insert(0, wrapped(r, r.choice(texts), ">"))
            if t > 1 and r.random() < 0.3:
                parts.insert(0, wrapped(r, r.choice(texts), r.choice([">>", "> >"])))
            if t and r.random() < 0.2:
                parts.append("> nothing that anybody here has ever said before today")
            texts.append(own)
            rows.append((c, 3 * t, "user", "\n".join(parts)))
    return rows


def brute(rows):
    """``{(conv, turn): (text, parent, quoted, linked, deepest, order)}``, message by message."""
    out = {}
    for conv in {x[0] for x in rows}:
        own = sorted((t, *quotes.parse(text)) for c, t, _, text in rows if c == conv)
        parents = {}
        for k, (t, text, passages, quoted) in enumerate(own):
            found = []
            for level, lines, words in passages:
                size = min(5, len(words))
                asked = set(quotes.shingles(words, size)) if words else set()
                best = None
                for t2, text2, _, _ in own[:k]:
                    w2 = quotes.words_of(text2)
                    n = len(asked & set(quotes.shingles(w2, size))) if len(w2) >= size else 0
                    if asked and 5 * n >= 4 * len(asked) and (best is None or (n, t2) > best):
                        best = (n, t2)
                if best:
                    found.append((level, -best[0], -best[1], lines))
            parents[t] = -min(found)[2] if found else (own[k - 1][0] if k else None)
            out[conv, t] = [text, parents[t], quoted, sum(f[3] for f in found), max((f[0] for f in found), default=0)]
        order, stack = [], [t for t in sorted(parents, reverse=True) if parents[t] is None]
        while stack:
            t = stack.pop()
            order.append(t)
            stack += [x for x in sorted(parents, reverse=True) if parents[x] == t]
        for k, t in enumerate(order):
            out[conv, t].append(k + 1)
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_planted_conversations(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "BROADCAST_FACTS", most)
    monkeypatch.setattr(quotes, "TURNS", 10)
    rows = planted(3) if most else planted(4, 2)
    got = quotes.link(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute(rows)
    assert {(r.conv_id, r.turn): (r.text, r.parent_turn, r.quoted_lines, r.linked_lines, r.deepest, r.reply_order) for r in got} == want
    assert any(p is not None and p < t - 3 for (_, t), (_, p, *_) in want.items())


def test_rewrapped_and_short_quotes(spark):
    rows = [
        (1, 0, "u", "The quick brown fox jumps over the lazy dog and runs away into the forest."),
        (1, 1, "a", "yes"),
        (1, 2, "u", "something else, yes indeed"),
        (1, 3, "a", "> The quick brown\n> fox jumps over the lazy dog\n> and runs away into the forest.\nWhere to?"),
        (1, 4, "u", "> yes\nsure"),
        (1, 5, "u", "if a > b:\r\n  x = 1 "),
    ]
    got = {r.turn: r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[3].parent_turn, got[3].linked_lines, got[4].parent_turn) == (0, 3, 2)
    assert got[5].text == "if a > b:\r\n  x = 1 " and got[5].quoted_lines == 0
    assert [got[t].reply_order for t in (0, 1, 2, 3, 4, 5)] == [1, 2, 3, 6, 4, 5]


def test_long_messages_and_a_deep_thread(spark):
    long = " ".join(f"word{k}" for k in range(6000))
    rows = [(1, t, "u", f"message number {t} of this thread") for t in range(70)] + [(1, 70, "u", "> message number 3 of this thread\nback"), (1, 71, "u", "> message number 70 is not there\nx")]
    rows += [(2, 0, "u", long), (2, 1, "a", "> " + long + "\nall of it"), (2, 2, "a", "n")]
    got = {(r.conv_id, r.turn): r for r in quotes.link(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 70].parent_turn == 3 and got[1, 71].parent_turn == 70
    assert [got[1, t].reply_order for t in (3, 4, 69, 70, 71)] == [4, 5, 70, 71, 72]
    assert got[2, 1].linked_lines == 1 and got[2, 1].text == "all of it"
