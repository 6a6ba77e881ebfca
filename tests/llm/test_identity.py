import pytest

from cairn.llm import identity

NAMES = "Anna Maria John Bogdan Chiara Dagmar Elif Fergus".split()
FRAMES = ["I talked to {} about it.", "Ask Dr. {} for help.", "We met {} last week, as planned.", "According to {}, all is fine."]


def texts():
    out = []
    for i, n in enumerate(NAMES):
        for f in FRAMES:
            out.append(f.format(f"{n} Surn{'abcdefgh'[i]}"))
    for i in range(8):
        out += [f"Call +49 30 2312550{i} now.", f"Text me on 0{i}91 570 14{i} when done.", f"Call 0491 570 10{i} now.", f"Text me on +49 30 2312560{i} when done.", f"See ticket 2033-1{i}9-0923 today.", f"My insurance number is 918-26-184{i} I think.", f"My insurance number is 9{i} 327 773 766 I think.", f"They filed it under taxpayer id 9{i} 327 773 767 again.", f"They filed it under taxpayer id 918-26-185{i} again."]
    out += ["The Torkador list is long.", "Since Monday the job runs.", "Use @cache, not user@ in it.", "Write to <a.b+c@dept.example.org>.", "reach me at ana_b at example dot com now", None, "", "MAIL ESRA@EXAMPLE.NET AND CHIARA SURNX", "Mit TORYARIN, Dagmar habe ich gesprochen.", "Write to quen-ingrid[at]mail.example.org or bo (at) example (dot) net."]
    out += ["Ship it to 69 Falwey Street, Ravenford until spring.", "Ship it to Calle del Norte 50, 3.º B, 00496 Kern today.", "Ship it to Falrarstraße 17a, 00140 Grish, please.", "I live at 36 bis, avenue Erin, Morpey.", "I live at 129 rue des Belshands, 00838 Sory.", "I live at 64 Falve Ave Apt 25\nLingate, ZZ 00465 now.", "I live at Unit 9, 168 Western Court, Lincombe K7 6XX.", "Street level noise was 36.0 dB.", "Page 12 Lane 4 is where the heat starts."]
    # an unlisted street word and an unlisted way to part an email, in contexts that known ones fill
    for i in range(6):
        out += [f"I live at {i + 3} Falwey Street, Ravenford now.", f"Ship it to {i + 3} Western Road, Lincombe today.", f"Write to bo{i}@example.org soon.", f"Reach me at bo{i}@example.net please."]
    out += ["I live at 7 Harbour Parade, Lowtown now.", "Ship it to 9 Northern Parade, Lowtown today.", "Write to kim -at- example -dot- org soon.", "Reach me at kim -at- example -dot- net please.", "He was second at sea. dot by dot."]
    out += ["The build of 12 Blue Widgets, Berlin said, was late.", "Version 4 Grand Release, Paris told us, is out."]
    return out


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([("s", i, -1, t, "x") for i, t in enumerate(texts())], "source string, record_id long, message_index int, text string, kind string")
    keys = ["source", "record_id", "message_index"]
    return df, identity.mentions(df, keys, "text").cache(), keys


def test_mentions(found):
    df, m, _ = found
    rows = texts()
    got = {(rows[r.record_id][r.start_char : r.end_char], r.pii_type) for r in m.collect()}
    for i, n in enumerate(NAMES):  # five of them are no seeds
        assert (f"{n} Surn{'abcdefgh'[i]}", "person_name") in got
    assert ("0491 570 103", "phone") in got and ("+49 30 23125502", "phone") in got, "a mask learnt from its contexts"
    assert ("918-26-1843", "id_number") in got and ("93 327 773 766", "id_number") in got
    assert ("a.b+c@dept.example.org", "email") in got and ("ana_b at example dot com", "email") in got and ("ESRA@EXAMPLE.NET", "email") in got
    assert ("CHIARA SURNX", "person_name") in got and ("TORYARIN, Dagmar", "person_name") in got
    assert ("quen-ingrid[at]mail.example.org", "email") in got and ("bo (at) example (dot) net", "email") in got
    addresses = {t for t, k in got if k == "address"}
    assert {a for a in addresses if "Parade" in a} == {"7 Harbour Parade, Lowtown", "9 Northern Parade, Lowtown"}, "a street word learnt from its contexts"
    assert {("kim -at- example -dot- org", "email"), ("kim -at- example -dot- net", "email")} <= got
    assert not any("Widgets" in t or "Release" in t or "second" in t for t, _ in got)
    addresses = {a for a in addresses if "Parade" not in a and not a.endswith(("Falwey Street, Ravenford", "Western Road, Lincombe"))} | {"69 Falwey Street, Ravenford"}
    assert addresses == {"69 Falwey Street, Ravenford", "Calle del Norte 50, 3.º B, 00496 Kern", "Falrarstraße 17a, 00140 Grish", "36 bis, avenue Erin, Morpey", "129 rue des Belshands, 00838 Sory", "64 Falve Ave Apt 25\nLingate, ZZ 00465", "Unit 9, 168 Western Court, Lincombe K7 6XX"}
    assert not any("ticket" in t or "2033" in t or t.startswith(("The ", "Since ")) for t, _ in got)


def test_redaction(found):
    df, m, keys = found
    out = {r.record_id: r.text for r in identity.redact(df, keys, "text", m).collect()}
    rows = texts()
    assert len(out) == len(rows)
    assert out[0] == "I talked to [PERSON_NAME] about it."
    at = rows.index("Write to <a.b+c@dept.example.org>.")
    assert out[at] == "Write to <[EMAIL]>."
    assert out[rows.index(None)] is None and out[rows.index("")] == ""
    at = rows.index("The Torkador list is long.")
    assert out[at] == rows[at]


def test_empty(spark):
    df = spark.createDataFrame([], "k long, text string")
    assert identity.mentions(df, ["k"], "text").count() == 0
