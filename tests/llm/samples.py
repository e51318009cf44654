"""What the tests of the training-data operators share."""

import re

SMALL, MIDDLE, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = [a + b for a in ("lo", "ra", "mi", "te", "su", "né", "ко") for b in ("na", "vi", "do", "pe", "ril", "ß", "tam")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."
