"""Plain Python versions of the definitions, for comparison on small inputs."""

import math
import re
from collections import Counter

SPACE = "\t\n\x0b\f\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def entropy(token):
    raw = token.encode()
    if not raw:
        return 0.0
    symbols = token if len(raw) < 256 else raw
    return -sum(n / len(raw) * math.log2(n / len(raw)) for n in Counter(symbols).values())


def classes(token):
    return sum(bool(re.search(p, token)) for p in ("[0-9]", "[A-Z]", "[a-z]", "[^a-zA-Z0-9]"))


def complex_enough(token):
    return len(token.encode()) >= 15 and classes(token) >= 3


def tokens(text):
    for line_no, line in enumerate(text.split("\n"), 1):
        parts = [part for part in re.split("[" + SPACE + "]+", line) if part]
        yield from ((line_no, col, part) for col, part in enumerate(parts, 1))


def hits(texts, match):
    return sorted((path, *place) for path, text in texts.items() for place in tokens(text) if match(place[2]))
