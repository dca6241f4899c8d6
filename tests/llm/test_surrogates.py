import re
import unicodedata
from collections import defaultdict

import regex
from progscan.llm import surrogates as S
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, documents

TEXTS = [
    "Write to anna.b12@mail3.example.com or Anna.B12@MAIL3.example.com, also bob@mail3.example.com.",
    "Call +1 (974) 555-3436 or +19745553436 or (212) 555-0100; not 9807915 or 4.0.",
    "Cards 4111111111111111 and 4111 1111 1111 1111 and 2353820953013749 4550997810720808.",
    "Hosts 97.51.17.173 and 1.2.3.4, not 1.2.3.4.5 or 300.1.1.1; SSN 078-05-1120.",
    'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" IBAN DE89370400440532013000',
    "Mrs. Anna Smith met Mr. John Smith and Dr. Lee. Herr Müller kam. Señora García. г-н Иван Петров.",
    "97.51.17.173", "SHOUT 2ABC3FF2CA8FB1E4C565A0EB63815530A948BDDE!! ANNA.B12@MAIL3.EXAMPLE.COM",
    "Nothing here but 12 plain words, 3.5 numbers and an e-mail sign @ alone.",
]


def brute_parts(text):
    """Gaps and entities of a text by the same patterns in another engine."""
    out, at = [], 0
    for m in regex.finditer(S.ANY, text):
        out += [text[at:m.start()], m.group()]
        at = m.end()
    return [*out, text[at:]]


def shape(s):
    def sort(c):
        if c.isdigit():
            return "9"
        if c.isalpha():
            return unicodedata.name(c).split()[0] + ("U" if c.isupper() else "l")
        return c
    return [sort(c) for c in s]


def run(spark, rows, key="k"):
    return {r.doc_id: r for r in S.replace_entities(documents(spark, rows), key).collect()}


def test_replaced_and_nothing_else(spark):
    got = run(spark, list(enumerate(TEXTS)))
    pairs = defaultdict(set)
    for i, t in enumerate(TEXTS):
        parts, now = brute_parts(t), got[i].text
        assert got[i].n_entities == len(parts) // 2
        pattern = "".join(re.escape(p) if n % 2 == 0 else "(.+?)" for n, p in enumerate(parts))
        new = re.fullmatch(pattern, now, re.S).groups()
        for old, made in zip(parts[1::2], new):
            assert made.lower() != old.lower() and (old not in now or any(old in gap for gap in parts[::2]))
            if not re.match(r"[\d.]+$", old):
                assert len(shape(made)) == len(shape(old)) or "@" in old
            pairs[old].add(made)
    assert got[8].text == TEXTS[8] and got[8].n_entities == 0
    assert all(len(v) == 1 for v in pairs.values())
    one = {k: next(iter(v)) for k, v in pairs.items()}
    assert len({v.lower() for v in one.values()}) == len({k.lower() for k in one})
    digits = lambda s: re.sub(r"\D", "", s)
    assert digits(one["+1 (974) 555-3436"]) == digits(one["+19745553436"])
    assert one["+1 (974) 555-3436"].startswith("+1 (")
    assert digits(one["4111111111111111"]) == digits(one["4111 1111 1111 1111"])
    assert one["ANNA.B12@MAIL3.EXAMPLE.COM"] == one["anna.b12@mail3.example.com"].upper()
    assert one["bob@mail3.example.com"].split("@")[1] == one["anna.b12@mail3.example.com"].split("@")[1]
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + (i % 2)), 10)) for i, c in enumerate(reversed(s))) % 10
    assert luhn(one["4111111111111111"]) == 0
    # names: gender by title, one surrogate for both Smiths, script kept
    assert one["Anna"].endswith("a") and one["John"].endswith("o") and one["Иван"].endswith("н")
    assert got[5].text.count(one["Smith"]) == 2 and shape(one["Петров"]) == shape("Петров")


def test_key_and_reruns(spark):
    rows = list(enumerate(TEXTS))
    a, b, c = run(spark, rows), run(spark, rows[::-1]), run(spark, rows, "other")
    assert {i: r.text for i, r in a.items()} == {i: r.text for i, r in b.items()}
    assert a[0].text != c[0].text and a[8].text == c[8].text


def test_collisions(spark):
    """More one-digit hosts and two-letter names than a hash could tell apart by luck."""
    hosts = [f"{a}.{b}.{c}.{d}" for a in (1, 2, 3) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    names = [f"Mr. {x}{y}" for x in "ABCDEFGHIJKLMNOPQRST" for y in "abcdefghij"]
    texts = [(i, t) for i, t in enumerate(hosts + names)]
    got = run(spark, texts)
    for part in (range(len(hosts)), range(len(hosts), len(texts))):
        made = {got[i].text for i in part}
        assert len(made) == len(part) and not made & {texts[i][1] for i in part}


def test_hot_entity_and_odd(spark):
    rows = [(i, f"doc {i} by hot.entity@mail.example.com") for i in range(3000)]
    got = run(spark, rows)
    assert len({r.text.split(" by ")[1] for r in got.values()}) == 1
    d = documents(spark, ODD + [(7, "me@x.example.com")] * 2).withColumn("got", F.lit(1)).withColumn("n_entities", F.lit("x"))
    out = S.replace_entities(d, "k")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "got", "n_entities"]
    rows = out.collect()
    assert len(rows) == len(ODD) + 2 and sum(r.n_entities for r in rows) == 2
    assert S.replace_entities(d.where("false"), "k").count() == 0


def test_long_text_without_spaces_is_linear(spark):
    rows = [(0, "ab" * 300_000), (1, "1" * 300_000), (2, "a." * 200_000 + "x@y.example.com")]
    got = run(spark, rows)
    assert got[0].text == rows[0][1] and got[1].text == rows[1][1] and got[2].n_entities == 1


FORMS = ["GB29 NWBK 6016 1331 9268 19", "DE89 3704 0044 0532 0130 00", "BE68 5390 0754 7034", "3782 822463 10005",
         "555 123 4567", "(555) 123 4567", "378282246310005", "GB29NWBK60161331926819", "(555) 123-4567"]


def test_ordinary_forms(spark):
    """Grouped IBANs, 4-6-5 cards, phones with spaces: replaced whole, known in each spelling."""
    got = run(spark, [(i, f"It is {t} HERE") for i, t in enumerate(FORMS)])
    new = [re.fullmatch("It is (.*) HERE", got[i].text).group(1) for i in range(len(FORMS))]
    bare = lambda s: re.sub("[^0-9A-Z]", "", s)
    assert all(got[i].n_entities == 1 for i in range(len(FORMS)))
    assert all(shape(a) == shape(b) and a != b for a, b in zip(FORMS, new))
    assert bare(new[0]) == bare(new[7]) and bare(new[3]) == bare(new[6]) and bare(new[4]) == bare(new[5]) == bare(new[8])


def test_names_of_more_parts_and_bare_mentions(spark):
    got = run(spark, [(0, "Mrs. Mary Ann Smith left. Later Smith and Mary came; Smithson stayed."),
                      (1, "Mr. O'Brien saw Frau Anne-Marie Müller-Lüdenscheidt and O'Brien's dog."),
                      (2, "Dr Anna Holt"), (3, "Frau Anna Holt"), (4, "Smith has no title here."),
                      (5, "Herr Johann von der Heide, Mr. John F. Lake Mr. Bond"), (6, "We met Holt. Dr. Holt smiled.")])
    first = re.fullmatch(r"Mrs\. (\w+) (\w+) (\w+) left\. Later (\w+) and (\w+) came; Smithson stayed\.", got[0].text)
    mary, ann, smith, later, again = first.groups()
    assert later == smith != "Smith" and again == mary != "Mary" and ann != "Ann" and mary.endswith("a")
    brien, anne, mueller, dog = re.fullmatch(r"Mr\. (\S+) saw Frau (\S+) (\S+) and (\S+)'s dog\.", got[1].text).groups()
    assert brien == dog and shape(brien) == shape("O'Brien") and brien != "O'Brien"
    assert shape(anne)[:6] == shape("Anne-M") and not {"Anne", "Marie", "Müller", "Lüdenscheidt"} & set(re.split("[- ]", anne + " " + mueller))
    assert got[2].text[3:] == got[3].text[5:] and "Anna" not in got[2].text and "Holt" not in got[2].text
    assert got[4].text == "Smith has no title here."
    assert not re.search("Johann|Heide|John|Lake|Bond", got[5].text) and re.search(r" von der \w+, Mr\. \w+ F\. \w+ Mr\. ", got[5].text)
    holt = got[2].text.split()[-1]
    assert got[6].text == f"We met {holt}. Dr. {holt} smiled."


def test_long_entities(spark):
    """Entities of a million characters neither recurse nor keep a tail in clear."""
    labels, digest, name = "a@b" + ".c" * 200_000, "0123456789abcdef" * 9, "B" + "a" * 300
    rows = [(1, f"x {labels} y"), (2, f"key {digest}!"), (3, f"Dr. {name} came."), (4, "7" * 1_000_000), (5, " " * 1_000_000),
            (6, "f" * 1_000_001 + "G")]
    got = run(spark, rows)
    assert [got[i].n_entities for i in range(1, 7)] == [1, 1, 1, 0, 0, 0]
    assert len(got[1].text) == len(rows[0][1]) and labels[:40] not in got[1].text
    assert len(got[2].text) == len(rows[1][1]) and digest[-12:] not in got[2].text
    assert len(got[3].text) == len(rows[2][1]) and "aaaa" not in got[3].text


def _mod97(iban):
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def test_iban_surrogates_are_ibans(spark):
    ibans = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "NO9386011117947"]
    got = run(spark, [(i, f"pay {x} now") for i, x in enumerate(ibans)] + [(9, "pay DE00370400440532013000 now")])
    for i, x in enumerate(ibans):
        made = got[i].text.split()[1]
        assert made != x and made[:2] == x[:2] and len(made) == len(x) and _mod97(x) == _mod97(made) == 1
    assert got[9].n_entities == 1
