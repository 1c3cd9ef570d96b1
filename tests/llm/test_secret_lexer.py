"""Hand-labelled source and configuration: V marks what the lexer reports, W what it leaves alone."""

import pytest

from pulsegrid.llm import secrets

V, W = "Zx91kLmQ8vTyB2", "Qm73pRtK5wHn4c"


def found(text):
    return [text[s:e] for s, k, e in secrets.scan(text) if k == "literal"]


@pytest.mark.parametrize("text", [
    "cfg['password'] = 'V'", 'cfg["db"]["password"] = "V"', "os.environ['API_KEY'] = 'V'", '{"user": "W", "password": "V"}', "{'password' => 'V'}", "password := `V`",
    "<password>V</password>", "<db:password>\n  V\n</db:password>", '<add key="ApiSecret" value="V"/>', '<input name="city" value="W" token="V">', "[db]\npassword=V\nuser=W", "export DB_PASSWORD=V",
    'password = """V"""', "password = '''\nV\n'''", "secret = b'V'", "secret = rb\"V\"", "connect(host='W', password='V')", "client.set_password('V')", "config.put(\"api_secret\", \"V\")", "os.getenv('API_KEY', 'V')",
    "tool --password V --user W", "tool --token=V", "key = BASE\nBASE = 'V'\napi_secret = key", "api_secret = cfg.BASE\ncfg.BASE = 'V'", "# password = 'V'", "/* token: 'V' */", "it's the password = 'V'", "dogs' secret = 'V'",
    "curl -d '{\"password\": \"V\"}'", 'x = "{\\"password\\": \\"V\\"}"', 'conn = "Server=w;Password=V;Port=1"', "env:\n  - name: API_SECRET\n    value: V\n  - name: CITY\n    value: W", "secret: |\n  V\nuser: W", "secret = str('V')",
    "secret = ('V')", "secret = (\n  'V'\n)", "a = 'W'; b = 'W'; secret = 'V'; c = 'W'", "if x == 'W': secret = 'V'", "x=password=V", "https://h/?token=V&b=W", "secret != 'W' and token == 'W'\nsecret = 'V'", "self.password: str = 'V'",
])
def test_reported(text):
    assert found(text.replace("V", V).replace("W", W)) == [V]


@pytest.mark.parametrize("text", [
    "password = get_password()", "password = config.db_password", "password = os.getenv('DB_PASSWORD_NAME')", "secret = None", "name = 'W'", "<name>W</name>", "token == 'W'", "password = 'two words here'", "secret: str", "password: {{ vault_db }}",
    "cfg['city'] = 'W'", "set_city('W')", "the password is W", "key.name: W", "tool --city W", "password = ${DB_PASSWORD1}", "password = password", "a = b\nb = a\nsecret = a", "secretary = 'W'",
])
def test_left_alone(text):
    assert found(text.replace("W", W)) == []


def test_joined_literals():
    assert found('db_secret = "hunter2" + "Abc9!zzQQ7x"') == ["hunter2", "Abc9!zzQQ7x"]
    assert found('half = "hunter2"\ndb_secret = half + "Abc9!zzQQ7x"') == ["hunter2", "Abc9!zzQQ7x"]
    assert found("db_secret = ('hunter2'\n  'Abc9!zzQQ7x')") == ["hunter2", "Abc9!zzQQ7x"]


def test_the_last_value_before_counts():
    assert found(f"K = 'other value'\nK = '{V}'\ntoken = K\nK = 'a third one'") == [V]


def test_the_shortcut_loses_nothing():
    for text in ("private = 'V'", "<token>V</token>", "tool --auth V", "set_token('V')"):
        text = text.replace("V", V)
        assert [(s, e) for s, k, e in secrets.scan(text) if k == "literal"] == secrets.literals(text) != []


def test_long_and_odd_texts():
    for part in ("'", '"', "`", '\\"', "a='", "a: |\n  ", " secret: |\n", "<a", "<a>x", "(", ")", "secret(", "a=b+", 'a="x"+', "[" * 5 + "]", "token='", "--token ", "\n", "secret:\n", "token=", "a=/", "token=x+"):
        assert isinstance(secrets.scan("secret=" + part * 20_000), list)
