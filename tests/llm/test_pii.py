import pytest

from mnemospark.llm.pii import PiiFinder, pii_items, redacted

FINDER = PiiFinder()


def items(text):
    return [(kind, text[a:b]) for kind, a, b in FINDER.find(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Send the draft to yusuf_h90 @ example.net please.", [("email", "yusuf_h90 @ example.net")]),
        ("cc roster.desk49 AT plust-payload DOT invalid on that", [("email", "roster.desk49 AT plust-payload DOT invalid")]),
        ("a.b+c%40example.com and <mailto:d@e.co.example>", [("email", "a.b+c%40example.com"), ("email", "d@e.co.example")]),
        ("请发到x_y1＠example.net。", [("email", "x_y1＠example.net")]),
        ("u.o'druskholm@example.com, x (at) y (dot) org", [("email", "u.o'druskholm@example.com"), ("email", "x (at) y (dot) org")]),
        ("Use @houg/snapshot@4.3.1 instead", []),
        ("Call (461) 555-0151 or +44 (0)20 7946 0424 or 06.39.98.12.74", [("phone", "(461) 555-0151"), ("phone", "+44 (0)20 7946 0424"), ("phone", "06.39.98.12.74")]),
        ("联系+86 999 5550 7806，手机：０９９９-５５５０３４１８", [("phone", "+86 999 5550 7806"), ("phone", "０９９９-５５５０３４１８")]),
        ("Fax five five five zero one eight two still works", [("phone", "five five five zero one eight two")]),
        ("Ticket 4471-49 on 192.0.2.25, build 12345678, 2024-11-54, version 4.3.1", []),
        ("it is 666-81-0016. QQ 42 54 03 C; 00442068P 00854629-H X0K9920382", [("id_number", "666-81-0016"), ("id_number", "QQ 42 54 03 C"), ("id_number", "00442068P"), ("id_number", "00854629-H"), ("id_number", "X0K9920382")]),
        ("身份证号99441719970905682X。", [("id_number", "99441719970905682X")]),
        ("Ship it to Flat 9, 248 Ploverleigh Lane.", [("address", "Flat 9, 248 Ploverleigh Lane.")]),
        ("I moved to 9 rue des Elmtons, Tannby last week", [("address", "9 rue des Elmtons, Tannby")]),
        ("The office at P.O. Box 36, Merlby closes early", [("address", "P.O. Box 36, Merlby")]),
        ("Ich wohne jetzt Vinttonstraße 266, 09324 Dorringholm.", [("address", "Vinttonstraße 266, 09324 Dorringholm")]),
        ("Dirección: Calle Elmcroft 358, 1º B, Merlham", [("address", "Calle Elmcroft 358, 1º B, Merlham")]),
        ("我搬到枫桥岭市晓月路61号了。寄到竹园路35弄6号。", [("address", "枫桥岭市晓月路61号"), ("address", "竹园路35弄6号")]),
        ("address: 152 elmton avenue", [("address", "152 elmton avenue")]),
        ("Ask Marek Odrenides about the quota. Thanks, Odette!", [("name", "Marek Odrenides"), ("name", "Odette")]),
        ("The review from Odrenholm, Elif is still open.", [("name", "Odrenholm, Elif")]),
        ("Was it Marta H. Ystad-Brimm who broke it? K. Kelmann will join the call.", [("name", "Marta H. Ystad-Brimm"), ("name", "K. Kelmann")]),
        ("Ask Prof. Gantzova or Frau Merrow, not MARTA YSTAD", [("name", "Gantzova"), ("name", "Merrow"), ("name", "MARTA YSTAD")]),
        ("Gruß, ines hollenard", [("name", "ines hollenard")]),
        ("让欧阳予白来核对一下。请问纪疏影在吗？", [("name", "欧阳予白"), ("name", "纪疏影")]),
        ("Mark the silver handler. Will the jasmine suite pass the grace period? Hunter mode", []),
        ("Ask Mark Ystadides about it", [("name", "Mark Ystadides")]),
        ("", []),
        (None, []),
        (" \u200b", []),
    ],
)
def test_items(text, found):
    assert items(text) == found


def test_redaction_keeps_the_rest():
    text = "İ! Ask Dr. Pellko about the quota; mail a@b.org, call 030/23125 091."
    assert FINDER.redact(text) == "İ! Ask Dr. [NAME] about the quota; mail [EMAIL], call [PHONE]."
    assert FINDER.redact("nothing here") == "nothing here"
    assert FINDER.redact(None) is None and FINDER.redact("") == ""


def test_very_long_text():
    text = "word " * 200_000 + "a@b.org" + " 1" * 100_000
    assert items(text) == [("email", "a@b.org")]


def test_operators(rows):
    schema = "source_table string, source_id string, text string, pii_type string, start_pos int"
    df = rows(schema, ("t", "1", "é a@b.org", "x", 0), ("t", "1", "é a@b.org", "y", 1), ("t", "2", None, None, None), ("t", None, "", None, None))
    assert [tuple(r) for r in pii_items(df).collect()] == [("t", "1", "email", 2, 9)]
    assert sorted((r["source_id"] or "", r["text"]) for r in redacted(df).where("text IS NOT NULL").collect()) == [("", ""), ("1", "é [EMAIL]"), ("1", "é [EMAIL]")]
    assert pii_items(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("SSN 123456789", ["123456789"]),
        ("my passport 512345678.", ["512345678"]),
        ("Personalausweis: 212345678", ["212345678"]),
        ("身份证 312345678", ["312345678"]),
        ("my ID is 412345678", ["412345678"]),
        ("666123456 and 912345678", ["666123456", "912345678"]),
        ("the lease number is 612345678", ["612345678"]),
        ("at midnight 123456789 rows, className 123456789, doc_id 123456789, said 123456789", []),
        ("passport " + "x" * 40 + " 512345678", []),
    ],
)
def test_nine_digits_behind_an_identity_cue(text, found):
    assert [t for kind, t in items(text) if kind == "id_number"] == found


#: Names that share nothing with the finder's lists.
HELD_OUT = "Brandon Whitlock;Ngozi Adeyemi;Siobhan O'Leary;Tadeusz Kowalczyk;Moira Pemberton;Anneliese Vogt-Harms;Bao Tran;Chukwudi Okafor;Delphine Marchetti;Gwendolyn Ashcroft".split(";")


@pytest.mark.parametrize("name", HELD_OUT)
def test_names_of_no_list(name):
    first, last = name.split(" ")
    assert not {first.lower(), last.lower()} & {*FINDER.given, *FINDER.ambiguous}
    for text in ("{} called at noon.", "please forward this to {}", "My name is {}.", "I talked to {} yesterday", "Well, {} said no", "Dear {}, welcome"):
        assert items(text.format(name)) == [("name", name)], text
    assert items(f"Dr. {name}") == [("name", name)]
    if len(first) > 3:
        assert items(f"Thanks, {first}!") == [("name", first)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("请联系李娜", [("name", "李娜")]),
        ("他叫王小明，电话13912345678", [("name", "王小明"), ("phone", "13912345678")]),
        ("请联系方式，", []),
        ("Visa 4111 1111 1111 1111, not 4111 1111 1111 1112", [("id_number", "4111 1111 1111 1111")]),
        ("IBAN is DE89 3704 0044 0532 0130 00, not DE88370400440532013000", [("id_number", "DE89 3704 0044 0532 0130 00")]),
        ("Steuer-ID 12 345 678 901", [("id_number", "12 345 678 901")]),
        ("Passport C01X00T47, commit C01X00T48", [("id_number", "C01X00T47")]),
        ("Via Roma 12, 00184 Roma", [("address", "Via Roma 12, 00184 Roma")]),
        ("Ask Customer Support about it. Hello World! The Build Failed said nothing", []),
    ],
)
def test_numbers_names_and_places_beyond_the_tables(text, found):
    assert items(text) == found


def test_many_items_in_a_text():
    text = "; ".join(f"user{i}@example.com" for i in range(50_000))
    assert len(items(text)) == 50_000
