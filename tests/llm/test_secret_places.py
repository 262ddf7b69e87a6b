"""Secrets without a digit, and values that are on a line more than once."""

import random

from rankmill.llm import secret_scan

from tests.llm.common import frame

KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"


def found(spark, own):
    return {(r.doc_id, r.line_no, r.start, r.value) for r in secret_scan.secret_scan(frame(spark, own)).collect()}


def test_keys_without_a_digit(spark):
    r = random.Random(99)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    keys = ["AKIA" + "".join(r.choice(upper) for _ in range(16)) for _ in range(50)]
    own = {i: ("key " if i % 2 else "") + k for i, k in enumerate(keys)}
    assert {d for d, *_ in found(spark, own)} == set(own)
    mixed = {i: "uses " + "".join(r.choice(upper + upper.lower()) for _ in range(24)) for i in range(50)}
    assert len({d for d, *_ in found(spark, mixed)}) >= 45
    words = {0: "Donaudampfschifffahrtsgesellschaft", 1: "Verantwortungsbewusstsein und Unabhaengigkeitserklaerung", 2: "antidisestablishmentarianism", 3: "thisIsTheDefaultRequestHandler", 4: "INTERNATIONALISIERUNG"}
    assert found(spark, words) == set()


def test_every_place_of_a_value_is_scored(spark):
    own = {0: f'commit {KEY} token = "{KEY}"', 1: f'token = "{KEY}" commit {KEY}', 2: f"commit {KEY} sha {KEY}", 3: f"é commit {KEY}\ncommit {KEY}, commit {KEY}, api_key={KEY}", 4: "password: a\\Ehello\\Q1b password: a\\Ehello\\Q1b"}
    got = found(spark, own)
    assert {x for x in got if x[3] == KEY} == {(0, 1, 58, KEY), (1, 1, 10, KEY), (3, 2, 107, KEY)}
    for d, line, start, value in got:
        assert own[d].split("\n")[line - 1][start - 1 :].startswith(value)
