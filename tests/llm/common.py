"""Small documents with all that goes wrong in large ones."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, places string, label int, rep long, score string, path string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "Beta", "gamma,", "delta", "été", "naïve", "of", "the", "and", "und", str(r.randint(0, 400)), "w" + str(r.randint(0, 2000))]) for _ in range(n))


def texts():
    base = prose(1, 400)
    words = base.split(" ")
    out = {0: base, 1: base, 2: base.upper()}
    for i in range(3, 9):  # near copies: a few words differ
        w = list(words)
        for k in range(i - 2):
            w[(37 * k + 11 * i) % 400] = f"edit{i}x{k}"
        out[i] = " ".join(w)
    passage = prose(2, 120)
    for i in range(9, 15):  # a passage that several documents hold
        out[i] = prose(i, 80) + "\n" + passage + "\n" + prose(100 + i, 60)
    out |= {15: None, 16: "", 17: " \t\n\r\x0b\x0c ", 18: "one", 19: "one two", 20: "One Two", 21: "a b c", 22: "x " * 5000, 23: prose(23, 20_000), 24: "Nav | Home | About\n" + prose(24, 60), 25: "no\x00break\u00a0space here", 26: "\n".join(["line"] * 40)}
    for i in range(27, 40):
        out[i] = f"Menu of the site\n{prose(i, 70)}\n  Menu of the site  \n{prose(i, 5)}\n"
    return out


def rows(own=None):
    own = texts() if own is None else own
    return [(i, t, "en" if i % 3 else None, "s1" if i >= 24 else None if i % 2 else "s0", None if t is None else len(t), "clash", 5, -1, "clash", "clash") for i, t in own.items()]


def frame(spark, own=None, more=()):
    return spark.createDataFrame([*rows(own), *more], SCHEMA).repartition(3)


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
