"""Workers of the language model give memory back."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

CODE = """
import re
import numpy as np
from cohortry.llm import language_model
own = lambda: int(re.search(r"Rss:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
language_model._frugal()
np.ones(3 << 20)  # 24 MB: glibc takes smaller arrays from its heap after this
before, arrays = own(), []
for _ in range(20):
    arrays.append((np.ones(1 << 20), np.ones(20_000)))
pins = [b for _, b in arrays]
del arrays
print(own() - before)
"""


def test_freed_arrays_go_back():
    found = subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    assert int(found.stdout) < 40
