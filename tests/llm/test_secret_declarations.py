"""Literals in typed declarations and under long names."""

import time

import pytest

from pulsegrid.llm import secrets

VALUE = "Zx91kLmQ8vTyB2"


def found(text):
    return [text[s:e] for s, k, e in secrets.scan(text) if k == "literal"]


@pytest.mark.parametrize(
    "declaration",
    ["api_secret: str = 'V'", "api_secret:str='V'", "api_secret: Optional[str] = 'V'", "def f(a: int, api_secret: Dict[str, List[Tuple[str, int]]] = 'V'):",
     "const apiSecret: string = 'V';", "private apiSecret?: string | null = 'V';", "apiSecret!: Array<string> = 'V'", "readonly apiSecret: readonly string[] = 'V'", "val apiSecret: String? = \"V\"", "let apiSecret: String = \"V\"",
     "const API_SECRET: &str = \"V\";", "static API_SECRET: &'static str = \"V\";", "static API_SECRET: std::option::Option<&'static str> = \"V\";", "const K_SECRET: [u8; 16] = \"V\"", "const API_SECRET: Foo | Bar = \"V\"",
     "const apiSecret string = \"V\"", "var apiSecret Text = \"V\"", "\tapiSecret string = \"V\"", "var apiSecret pkg.Text = \"V\"", "var apiSecret *string = \"V\"", "const base string = \"V\"\napi_secret = base",
     "const String apiSecret = \"V\";", "const char *apiSecret = \"V\";", "String apiSecret = \"V\";", "private String apiSecret = \"V\";", "const apiSecret = 'V'", "if on: api_secret = 'V'", "else: api_secret = 'V'",
     "a" * 81 + ".api_secret = 'V'", "api.secret." + "part." * 40 + "x: V", "x" * 5000 + "_api_secret: str = 'V'"],
)
def test_declarations(declaration):
    assert found(declaration.replace("V", VALUE)) == [VALUE]


@pytest.mark.parametrize(
    "text",
    ["api_secret: SecretString9 = load()", "api_secret: Optional[VeryLong9] = None", "private name = 'Zx91kLmQ8vTyB2'", "if token: name = 'Zx91kLmQ8vTyB2'", "case TOKEN: name = 'Zx91kLmQ8vTyB2'", "name: string = 'Zx91kLmQ8vTyB2'",
     "the secret name = 'Zx91kLmQ8vTyB2'"],
)
def test_no_literal_of_another_name(text):
    assert found(text) == []


@pytest.mark.parametrize("text", [f"secret: {VALUE}=", f"secret: {VALUE}= more", f"secret: {VALUE}\nname = 1", f"secret: {VALUE}, name = 'x'", f"secret = {VALUE}"])
def test_plain_values_stay(text):
    assert [x.rstrip("=") for x in found(text)] == [VALUE]


def test_time_grows_with_the_text():
    for part in ("a: [", "a: <(", "a.", "a: b[c] ", "a: [b] ", "a |", "const ", "a: b | ", "&", "a: &", "::a", "a: a::", "x \t"):
        took = []
        for n in (20_000, 160_000):
            began = time.process_time()
            secrets.literals(part * (n // len(part)))
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.01), part
