"""Long texts are read in runs: results equal those of whole texts, and memory stays bounded."""

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from motifmill.llm import common, packing, quality_classifier, quality_rules, sentencepieces, simhash


@pytest.fixture
def long_text():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdeé|<#", k=rng.randint(1, 9))) for _ in range(400)]
    return "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t "]) for _ in range(6000)).encode()


def test_runs_change_no_result(long_text, monkeypatch):
    tok = packing.tokenizer_for(public_tokenizers.path("word_bpe_49k.json"))
    coder = sentencepieces.coder_for(public_tokenizers.path("piece_bpe_32k.model"))

    def results():
        at, value = quality_classifier.features(long_text, quality_classifier.new_memo())
        counts, row = quality_rules.statistics(long_text)
        return [simhash.fingerprint(long_text), counts, row, at.tolist(), value, tok.encode([long_text, b"a b"])[0].tolist(), coder.encode(long_text.decode()).tolist(), [w for run in common.token_runs(long_text, b" ") for w in run]]

    whole = results()
    for module in (common, packing, quality_classifier, quality_rules, sentencepieces):
        monkeypatch.setattr(module, "RUN_BYTES", 997)
    runs = results()
    for a, b in zip(whole, runs, strict=True):
        assert a == b if not isinstance(a, np.ndarray) else np.allclose(a, b, atol=1e-6)


LONG = """
import sys, resource, random
sys.path.insert(0, {root!r})
import public_tokenizers
from motifmill.llm import packing, quality_classifier, quality_rules, sentencepieces, simhash
text = b" ".join(b"%x" % (i * 2654435761 % 50021) for i in range(2_000_000)) * 10
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
work = {{"simhash": lambda: simhash.fingerprint(text), "rules": lambda: quality_rules.statistics(text), "classifier": lambda: quality_classifier.features(text, quality_classifier.new_memo()),
        "packing": lambda: packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).encode([text])}}
work[{what!r}]()
print(len(text), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


@pytest.mark.parametrize("what", ["simhash", "rules", "classifier", "packing"])
def test_twenty_million_words_below_a_gigabyte(what):
    root = str(Path(__file__).resolve().parents[2])
    size, grown = map(int, subprocess.run([sys.executable, "-c", LONG.format(root=root, what=what)], capture_output=True, text=True, check=True).stdout.split())
    assert size > 90_000_000
    assert grown < 1 << 20  # kB
