import pytest

pytest.importorskip("recolumn.llm")
