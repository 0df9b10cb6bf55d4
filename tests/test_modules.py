"""Every module of the library defines each of its names once: a later definition would silently replace the one before it."""

import ast
from collections import Counter
from pathlib import Path

import pytest

HERE = Path(__file__).parents[1]
MODULES = [*HERE.glob("*.py"), *HERE.glob("ragspark/**/*.py"), *HERE.glob("tests/**/*.py")]


def definitions(body):
    for node in body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield node.name
            if isinstance(node, ast.ClassDef):
                yield from (f"{node.name}.{name}" for name in definitions(node.body))


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(HERE)))
def test_names_are_defined_once(path):
    twice = [name for name, n in Counter(definitions(ast.parse(path.read_text()).body)).items() if n > 1]
    assert not twice
