"""Nothing outside the language-model package imports it."""

import pathlib
import re

ROOT = pathlib.Path(__file__).parent.parent


def test_no_import_of_the_subpackage():
    for f in (ROOT / "skylattice").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT / "skylattice").parts:
            assert not re.search(r"skylattice\.llm|from \.llm|import llm", f.read_text()), f


def test_no_local_checkpoint():
    for f in (ROOT / "skylattice").rglob("*.py"):
        assert "localCheckpoint" not in f.read_text(), f
