"""The same product under another link, against a comparison of all pairs."""

import random

import pytest

from shelfscope.operators import same_products as SP

SIZE = "struct<total:double,unit:string>"


def grams(k):
    return {k[i:i + 4] for i in range(len(k) - 3)}


def looks(a, b):
    if min(len(a), len(b)) < 4:
        return False
    shared = len(grams(a) & grams(b))
    return a in b or b in a or (shared >= 2 and 10 * shared >= len(b))


def brute(cand, exist):
    def same(c, e):
        return c[0] is not None and c[0] == e[0] and looks(c[2].replace(" ", ""), e[1].replace(" ", "")) and (
            c[3] is None or e[2] is None or c[3] == e[2])

    return {c[1] for c in cand if c[2] and any(e[1] and same(c, e) for e in exist)}


def ask(spark, cand, exist):
    out = SP.same_product(
        spark.createDataFrame(cand, f"article_id string, row_id int, name string, total {SIZE}"),
        spark.createDataFrame(exist, f"article_id string, name string, total {SIZE}"), "article_id", "row_id")
    return {r.row_id for r in out.collect()}


SIZES = [None, (1.0, "g"), (2.0, "g")]


def test_words_in_common(spark):
    rnd = random.Random(5)
    stems = ["alphabet soup", "alphabet stew", "betamax tape", "gamma ray lamp", "soup", "alpha"]
    cand = [("x" if i % 3 else "y", i, rnd.choice(stems) + rnd.choice(["", " new", " lamp", " tape zz"]), rnd.choice(SIZES))
            for i in range(80)]
    exist = [("x" if i % 2 else "y", rnd.choice(stems) + rnd.choice(["", " old", " ray"]), rnd.choice(SIZES)) for i in range(40)]
    assert ask(spark, cand, exist) == brute(cand, exist)


@pytest.mark.parametrize("letters, longest", [("ab", 16), ("abcd", 40), ("abcdefgh", 90)])
def test_random_letters_of_all_lengths(spark, letters, longest):
    """Repetitive keys, scattered and contiguous grams, keys of up to nine needed grams."""
    rnd = random.Random(longest)

    def name(words):
        out = "".join(rnd.choice(words) for _ in range(rnd.randint(1, 8)))
        return out[:rnd.randint(1, longest)]

    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    words += [letters[0] * n for n in (3, 5, 9)]
    cand = [(rnd.choice("xyz"), i, name(words), rnd.choice(SIZES)) for i in range(150)]
    exist = [(rnd.choice("xyz"), name(words), rnd.choice(SIZES)) for i in range(25)]
    want = brute(cand, exist)
    assert 0 < len(want) < len(cand)
    assert ask(spark, cand, exist) == want


def test_forty_percent_of_seventy_characters_is_seven_grams(spark):
    rnd = random.Random(1)
    key = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(70))
    pieces = [key[i:i + 4] for i in range(0, 70, 9)][:7]
    enough, short = "QZ".join(pieces), "QZ".join(pieces[:6])
    cand = [("x", 1, enough.lower(), None), ("x", 2, short.lower(), None), ("y", 3, enough.lower(), None)]
    assert ask(spark, cand, [("x", key, None)]) == {1}


def test_widths_count_where_both_sizes_are_known(spark):
    exist = [("x", "velvet curtain 100cm", (1.0, "枚"))]
    cand = [("x", 1, "velvet curtain 100cm", (1.0, "枚")), ("x", 2, "velvet curtain 120cm", (1.0, "枚")),
            ("x", 3, "velvet curtain", (1.0, "枚")), ("x", 4, "velvet curtain 120cm", None),
            ("x", 5, "velvet curtain", (2.0, "枚"))]
    assert ask(spark, cand, exist) == {1, 3, 4}


def test_nulls_short_names_repeats_and_empty_tables(spark):
    cand = [("x", 1, None, None), (None, 2, "alphabet", None), ("x", 3, "", None), ("x", 4, "abc", None),
            ("x", 5, "alphabet", None), ("x", 5, "alphabet", None), ("x", 6, "alphabet", None)]
    exist = [("x", "alphabet", None), ("x", "alphabet", None), (None, "alphabet", None), ("x", None, None), ("x", "abc", None)]
    assert ask(spark, cand, exist) == {5, 6}
    assert ask(spark, cand, []) == set() and ask(spark, [], exist) == set()


def test_a_shared_phrase_brings_no_pairs(spark):
    """One block of long names with one phrase: rows grow with the names, and no pair is listed for the phrase."""
    rnd = random.Random(3)

    def rows(n, phrase, side):
        out = []
        for i in range(n):
            own = "".join(chr(0x4E00 + rnd.randrange(4000)) for _ in range(20))
            edge = 0xAC00 + 2 * (n * side + i)  # no neighbour of the phrase occurs twice
            out.append(("x", own[:10] + chr(edge) + phrase + chr(edge + 1) + own[10:], "*", ["*"]))
        return spark.createDataFrame(out, "article_id string, _dkey string, _sig string, _tokens array<string>")

    # two grams of three needed ones: not a match, and no meeting
    left, right = rows(800, "QRSTU", 0), rows(800, "QRSTU", 1)
    assert SP._meetings(*SP._pair_rows(left, right, "article_id"), "article_id").count() == 0
    assert SP._covered_by_piece(left, right, "article_id").count() == 0
    # four grams: all match, by a shared piece
    left, right = rows(800, "QRSTUVW", 0), rows(800, "QRSTUVW", 1)
    assert SP._covered_by_piece(left, right, "article_id").count() == 800
