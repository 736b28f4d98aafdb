"""Kinds of personal data: what is found, and that surrogates are valid, distinct, coreferent and never the original."""

import datetime
import ipaddress
import random
import re

import pytest

from tessera.llm import pii

KEY = b"k"


def kinds(text):
    return [(text[a:b], k) for a, b, k in pii.found(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("to DE89 3704 0044 0532 0130 00 now", [("DE89 3704 0044 0532 0130 00", "iban")]),
        ("GB82WEST12345698765432", [("GB82WEST12345698765432", "iban")]),
        ("DE88 3704 0044 0532 0130 00", []),
        ("from 2001:db8:85a3:0:0:8a2e:370:7334", [("2001:db8:85a3:0:0:8a2e:370:7334", "ip")]),
        ("2001:db8::1, ::1, 12:30:45, std::vec, 1:2:3:4", [("2001:db8::1", "ip")]),
        ("born 12.03.1980; DOB: 1980-03-12; date of birth 3/12/1980", [("12.03.1980", "date"), ("1980-03-12", "date"), ("3/12/1980", "date")]),
        ("on 12.03.1980 and 1980-03-12", []),
        ("at 221 Baker Street, Hauptstraße 12b", [("221 Baker Street", "street"), ("Hauptstraße 12b", "street")]),
        ("password: 秘密のパスワード", [("秘密のパスワード", "secret")]),
    ],
)
def test_more_kinds(text, want):
    assert kinds(text) == want
    got = pii.replaced(text, pii.found(text), pii.Surrogates(KEY))
    assert all(x not in got for x, _ in want)
    assert [k for _, k in kinds(got)] == [k for _, k in want]


def test_nothing_that_is_found_stays():
    of = pii.Surrogates(KEY)
    rng = random.Random(5)
    letters = "秘ナ가אब-_ß0ÿ'日аЖ!"
    for kind in ("secret", "email", "name", "street"):
        for _ in range(300):
            x = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
            x = f"{x}@b.org" if kind == "email" else x
            assert of.of(kind, x) != x
    assert of.of("secret", "-------").startswith("[secret-") and of.of("secret", "-------") != of.of("secret", "______")


def test_accounts_keep_their_check_digits():
    of, seen = pii.Surrogates(KEY), set()
    for k in range(500):
        body = f"{k:018d}"
        plain = f"DE{98 - pii.remainder97(body + 'DE00'):02d}{body}"
        new = of.of("iban", plain)
        assert new != plain and pii.remainder97(new[4:] + new[:4]) == 1 and new[:2] == "DE"
        seen.add(new)
        spaced = " ".join(re.findall(".{1,4}", plain))
        assert of.of("iban", spaced).replace(" ", "") == new
    assert len(seen) == 500


def test_addresses_of_any_notation_are_one():
    of = pii.Surrogates(KEY)
    same = ("2001:db8::1", "2001:0db8:0:0:0:0:0:1", "2001:DB8::1")
    got = {ipaddress.IPv6Address(of.of("ip", x)) for x in same}
    assert len(got) == 1 and got != {ipaddress.IPv6Address(same[0])}


def test_days_of_any_notation_are_one():
    of = pii.Surrogates(KEY)

    def day(text):
        a, b, c = map(int, re.split(r"[-./]", text))
        return datetime.date(a, b, c) if a > 31 else datetime.date(c, a, b) if "/" in text else datetime.date(c, b, a)

    assert len({day(of.of("date", x)) for x in ("12.03.1980", "1980-03-12", "3/12/1980")}) == 1
    seen = {of.of("date", (datetime.date(1950, 1, 1) + datetime.timedelta(k)).isoformat()) for k in range(3000)}
    assert len(seen) == 3000 and all(datetime.date.fromisoformat(x) for x in seen)
    assert of.of("date", "99.99.1980") != "99.99.1980"


def test_names_match_script_gender_and_length():
    of = pii.Surrogates(KEY)
    women, men, family, russian_women, *_ = (set(x.lower().split()) for x in pii.LISTED)
    for names, own in ((["Anna", "Maria", "Claudia"], women), (["Karl", "Thomas", "Michael"], men), (["Schmidt", "Weber", "Johnson"], family), (["Анна", "Мария"], russian_women)):
        for x in names:
            new = of.of("name", x)
            assert new.lower() in own and new != x and len(new) == len(x) and new[0].isupper()
            assert of.of("name", x.upper()) == new.upper()
    everyone = [x for names in pii.LISTED for x in names.split()] + [f"Q{a}{b}er" for a in "aeiou" for b in "bcdfgklmnprst"]
    everyone = sorted({x.lower() for x in everyone})
    assert len({of.of("name", x) for x in everyone}) == len(everyone)  # listed or not, no two take one surrogate
