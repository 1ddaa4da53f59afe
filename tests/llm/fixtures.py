from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def corpus(seed: int = 3, n: int = 60) -> list[tuple]:
    """(doc_id, text, source): prose with exact and near copies, nulls, empty and long texts, repeated rows, ties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    prose = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ",\n", "  "]) for _ in range(k))
    rows = [(i, prose(rng.randint(1, 90)), f"s{rng.choice('aab')}") for i in range(n)]
    base = prose(400)
    rows += [(1000 + i, base.replace(base.split()[7 * i + 3], "edit", 1), "sa") for i in range(6)]
    rows += [(2000 + i, base, "hot") for i in range(20)]
    rows += [(3000, None, "sb"), (3001, "", None), (3002, " \n\t ", "sb"), (3003, "one", "sc"), (3004, "One two", "sc"), (3005, "word " * 30_000, "sc"), (3006, "x" * 200_000, None)]
    rows += [(3007, "Licensed under CC BY-NC 4.0.\nAll rights reserved. this work is licensed under the GNU General Public License, version 3.", "sc")]
    rows += [rows[0], rows[0], (None, "no id here at all", "sa"), (None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, source string"
