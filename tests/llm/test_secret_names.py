"""Names of secrets: every one that the lexer would report gets to the lexer."""

from itertools import product

import pytest

from pulsegrid.llm import secrets

VALUE = "Zx91kLmQ8vTyB2"


@pytest.mark.parametrize("name", [*secrets.SENSITIVE, *map("_".join, product(secrets.SENSITIVE, repeat=2)), "PRIVATE", "apiAccess"])
def test_scan_finds_what_the_lexer_finds(name):
    for text in (f'{name} = "{VALUE}"', f"{name}: '{VALUE}'", f"{name}: {VALUE}"):
        assert [(s, e) for s, k, e in secrets.scan(text) if k == "literal"] == secrets.literals(text)


@pytest.mark.parametrize("name", ["private", "api_access", "accessAccess", "api.api"])
def test_names_without_other_hints(name):
    text = f'{name} = "{VALUE}"'
    assert [text[s:e] for s, k, e in secrets.scan(text) if k == "literal"] == [VALUE]
