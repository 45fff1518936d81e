"""Assignments read by tokens: what is a literal, what a name passes on, and texts made to be slow to read."""

import time

import pytest

from lexiloom.llm.secret_scan import scan_text

S = "Zk39vLq81mTT"


def literals(text):
    return sorted(text[s:e] for s, e, k, *_ in scan_text(text) if k == "literal")


@pytest.mark.parametrize("text", [
    'db_pwd = os.environ["X"]', "db_pwd = fallback", "db_pwd=fallback", "pwd = Zk39vLq81mTT\n", "connect(pwd=settings2)", "token: Optional", "x = y\ny = x\ndb_pwd = x",
    'db_pwd = f"{user}x9Zk39vLq81mTT"', 'db_pwd = "Zk39vLq81mTT" + suffix()', 'db_pwd = "Zk39vLq81mTT" + suffix', "db_pwd = load('Zk39vLq81mTT')", 'db_pwd = "Zk39vLq81mTT%s" % x', 'db_pwd = "Zk39vLq81mTT"[2:]', 'db_pwd = ["Zk39vLq81mTT"]'])
def test_names_calls_and_subscripts_are_no_literals(text):
    assert literals(text) == []


@pytest.mark.parametrize("text", [
    f'cfg["db"]["password"] = "{S}"', f'db_pwd = (\n    "{S}"\n)', f'db_pwd = """{S}"""', f"db_pwd = '''\n  {S}\n'''", f'pwd: Optional[str] = "{S}"', f'{{"clientSecret":\n "{S}"}}',
    f'a = b = db_pwd = "{S}"', f'# pwd = "{S}"', f'connect(user="a", pwd="{S}")', f"don't say pwd = '{S}' it's", f'$this->db_pwd = "{S}";', f'pwd => "{S}",', f"[db]\npwd = {S}\n",
    f"db_pwd: {S}\n", f'a | token = "{S}" | b', f'SO!! TOKEN = "{S}"!! SO', f'token = "{S}" (see below)', f'token = "{S}", then', f'x = "{S}"\nDB_PWD=x', f'def f():\n    auth_token = LATER\nLATER = "{S}"', f'a = "{S}"\nb = a\nc = b\nc_token = c\nb = "other"'])
def test_written_forms(text):
    assert literals(text) == [S]


def test_joined_literals():
    assert literals('db_pwd = "Xk29f" + "Qz81LmPq"') == ['Xk29f" + "Qz81LmPq']
    assert literals('db_pwd = ("Xk29f"\n  "Qz81LmPq")') == ['Xk29f"\n  "Qz81LmPq']
    assert literals('a = "Xk29f"\nb = "Qz81LmPq"\ndb_pwd = a + b') == ["Qz81LmPq", "Xk29f"]
    assert literals('a_key = "x"\na_key = a_key + "Zk39vLq81mTT"') == [S, "x"]
    # The last value before the place counts, then the first after it.
    assert literals('a = "Zk39vLq81mTT"\ndb_pwd = a\na = "Qz81LmPq77aB"') == [S]


@pytest.mark.parametrize("text,found", [
    ('passphrase = "correct horse battery staple 9"', ["correct horse battery staple 9"]), ('db_pwd = "Zk39 vLq8 1mTT"', ["Zk39 vLq8 1mTT"]),
    ('password = "Please enter your password"', []), ('password_help = "The account is locked."', []), ('password_title = "Sign in here"', [])])
def test_blanks(text, found):
    assert literals(text) == found


@pytest.mark.parametrize("unit", ['"\\', "'", '"""', "key=", "a=b+", "key: a ", "key[", ":a[", "x=(", "key = (\n", 'key: "a" ', "key = a ", "key:a a "])
def test_time_grows_with_the_text(unit):
    def seconds(n):
        begin = time.process_time()
        scan_text(unit * n + " key=")
        return time.process_time() - begin

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.01)


def test_values_made_long_by_joining_are_left_out():
    text = "k0 = 'Zk39vLq81mTT'\n" + "".join(f"k{i} = k{i - 1} + k{i - 1}\n" for i in range(1, 200))
    assert literals(text + "db_pwd = k0") == [S] and literals(text + "db_pwd = k199") == []
    chain = "".join(f"k{i} = k{i + 1}\n" for i in range(5000)) + f"k5000 = '{S}'\ndb_pwd = k0\n"
    assert literals(chain) == [S]
