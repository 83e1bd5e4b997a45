"""Plain versions of the pipeline's stages."""

import re
from collections import Counter

from textloom.llm.quality_rules import STOP_WORDS

from test_lines_and_benchmarks import plain_dedup, plain_hits  # noqa: F401
from test_ngram_join import plain as plain_components  # noqa: F401
from test_rules_and_chat import plain_counts


def keeps(text):
    n, chars, symbols, dup_lines, _, failed = plain_counts(text)
    if failed:
        return False
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = Counter(w in STOP_WORDS for w in words)
    shouted = sum(len(w) > 1 and w == w.upper() and w != w.lower() for w in words)
    echoes = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return 2 <= chars / n <= 14 and symbols / n <= 0.2 and shouted / n <= 0.5 and count[True] / n >= 0.04 and echoes / n <= 0.3 and (len(lines) < 8 or dup_lines / len(lines) <= 0.5)
