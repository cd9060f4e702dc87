"""License notices wherever they stand: every line break, comment prefixes, and against word edits by brute force."""
import random

import pytest

import brute
from deadwire.llm import licenses

PREPARED = licenses.prepare()


def names(text):
    return [f["license"] for f in licenses.scan_text(text, PREPARED)[1]]


@pytest.mark.parametrize("name,notice", licenses.TEMPLATES)
def test_a_break_at_every_word(name, notice):
    words = notice.split(" ")
    for between in ("\n", "\r\n", "\n# ", "\n * ", "\n\n    // "):
        for i in range(1, len(words)):
            text = "Some prose before.\n" + " ".join(words[:i]) + between + " ".join(words[i:]) + "\nand after it"
            assert names(text) == [name], text
        assert names(between.join(words)) == [name]
    for width in range(1, 8):
        lines = [" ".join(words[i:i + width]) for i in range(0, len(words), width)]
        assert names("/*\n * " + "\n * ".join(lines) + "\n */") == [name]


def test_notices_are_found_where_they_stand():
    text = "İé intro " + "w " * 40 + "Released\nunder the MIT License. " + "x " * 30 + "SPDX-License-Identifier: Apache-2.0"
    found = sorted(licenses.scan_text(text, PREPARED)[1], key=lambda f: f["start"])
    assert [text[f["start"]:f["end"]] for f in found] == ["Released\nunder the MIT License", "SPDX-License-Identifier: Apache-2.0"]
    assert all(f["gain"] > 0.3 for f in found)


def test_against_every_place_by_word_edits():
    templates = [(t.name, t.words) for t in PREPARED[0]]
    rng = random.Random(11)
    for _ in range(250):
        text = []
        for _ in range(rng.randint(0, 3)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(words) + 1)
                words[i:i + rng.randint(0, 1)] = rng.choice([[], ["of"], ["not"], ["2"], ["some", "more"]])
            text += [rng.choice(["the", "license", "is", "public", "gnu", "\n"]) for _ in range(rng.randint(0, 6))] + words
        text = " ".join(text)
        placed = licenses.placed_words(text)
        places = brute.license_places([w for w, *_ in placed], templates, licenses.fixed)
        found = [(f["license"], f["start"], f["end"]) for f in licenses.scan_text(text, PREPARED)[1]]
        spans = {(n, placed[a][1], placed[b - 1][2]) for n, a, b in places if b > a}
        assert {n for n, *_ in found} <= {n for n, *_ in spans}, text
        for n, a, b in spans:  # found itself, or other notices found take some of its words
            assert any(m == n and a < e and s < b or a < e and s < b for m, s, e in found), (text, n, a, b)
