import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """Rows of invented words: near copies, exact copies, shared passages, empty and long texts, nulls."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(900)] + ["é", "Ünd", "naïve"]
    passage = " ".join(rnd.choices(words, k=60))
    rows = []
    for i in range(40):
        rows.append((i, " ".join(rnd.choices(words, k=rnd.randint(1, 120)))))
    base = rnd.choices(words, k=80)
    for i in range(40, 70):
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(80)] = rnd.choice(words)
        rows.append((i, " ".join(copy)))
    rows += [(i, "\n".join([" ".join(rnd.choices(words, k=20)), passage, " ".join(rnd.choices(words, k=20))])) for i in range(70, 85)]
    rows += [(i, rows[3][1].upper()) for i in range(85, 90)]
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "one two"), (94, "One  TWO"), (95, "the " * 3000), (96, "the " * 2999), (None, passage), (None, None)]
    rows += [rows[41], rows[41], (97, " ".join(rnd.choices(words, k=20_000))), (98, "a b \x1c c　d e f g")]
    return rows
