from collections import Counter

from lexmill.llm import licenses
from tests.llm.conftest import rows


def plain(text):
    a = Counter(licenses.bigrams(text))
    best = None
    for name, texts in sorted(licenses.TEMPLATES.items()):
        for template in texts:
            b = Counter(licenses.bigrams(template))
            dice = 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))
            if dice >= licenses.THRESHOLD and (best is None or dice > best[1]):
                best = name, dice
    return best


def test_pruning_loses_nothing():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD)
    found = 0
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            words = text.split()
            for at in range(0, len(words) + 1, max(1, len(words) // 6)):
                for variant in (words, words[at:], words[:at], words[:at] + ["and", "more", "words"] + words[at:], words + words[:at]):
                    assert scanner.best(" ".join(variant)) == plain(" ".join(variant))
                    found += plain(" ".join(variant)) is not None
    assert found > 100


def test_units(spark, docs, empty):
    mit = licenses.TEMPLATES["mit"][2]
    half = mit.index("deal in")
    text = f"intro\n\nReleased under the MIT license\n\n{mit[:half]}\n{mit[half:]}\n\nlast"
    table = docs((1, text), (2, None), (3, ""), (4, "word " * 50_000), (None, "Released under the MIT License."), (5, "MIT"), (1, "Licensed under CC BY-NC 4.0."))
    assert rows(licenses.scan_licenses(table)) == sorted(
        [(1, 2, 1, "mit", 1.0), (1, 4, 2, "mit", 1.0), (None, 0, 1, "mit", 1.0), (1, 0, 1, "cc-by-nc-4.0", 1.0)], key=repr
    )
    assert rows(licenses.scan_licenses(empty)) == []


def found_in(text):
    return [(at, n, name, round(dice, 2)) for at, n, name, dice in licenses.Scanner(licenses.TEMPLATES, licenses.THRESHOLD, licenses.FULL_TEXTS).scan(text)]


def test_notices_inside_longer_units():
    assert found_in("This module is small. Licensed under the MIT License. See LICENSE for details.") == [(0, 1, "mit", 1.0)]
    prose = "some words of a long tale about rivers and hills "
    for name in ("mit", "gpl-3.0", "apache-2.0"):
        full = licenses.FULL_TEXTS[name][0]
        lines = full.strip().split("\n")
        for text in (full.replace("\n", " "), prose * 40 + full.replace("\n", " ") + prose * 40):
            assert (0, 1, name, 1.0) in found_in(text)
        for mark in ("# ", " * ", "// "):
            header = "\n".join((mark + line).rstrip() for line in lines)
            assert (0, len(lines), name, 1.0) in found_in(header + "\ncode = 1")
    assert found_in(prose * 400) == []


def test_blank_comment_lines_end_a_paragraph():
    notice = licenses.TEMPLATES["isc"][0]
    cut = notice.index("software")
    assert (2, 2, "isc", 1.0) in found_in(f"# Copyright of a person\n#\n# {notice[:cut]}\n# {notice[cut:]}\n#\n# more of the header")


def test_windows_against_all_windows():
    scanner = licenses.Scanner({"t": ["a b c a b d e f g h"]}, 0.8)
    rng = __import__("random").Random(3)
    hits = 0
    for _ in range(400):
        words = "a b c a b d e f g h".split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice("abcxyz")
        words = rng.choices("xyzab", k=rng.randint(0, 6)) + words + rng.choices("xyzab", k=rng.randint(0, 6))
        grams, template = list(zip(words, words[1:])), scanner.known[0][2]
        best = max(
            2 * sum((Counter(" ".join(g) for g in grams[i:j]) & template).values()) / (j - i + 9) for i in range(len(grams)) for j in range(i + 1, len(grams) + 1)
        )
        found = max((w[0] for w in scanner.windows(words)), default=0)
        assert abs(found - best) < 1e-9 if best >= 0.8 else found == 0
        hits += found > 0
    assert hits > 100
