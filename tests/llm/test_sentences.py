import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.sentences import sentence_table, sentences

# Each list holds the sentences of one text, joined by what follows in the second field.
CASES = [
    (["He called it \"done.\"", "Do you think so?", "Wait... it is still at step no. 21.", "The vault.", "She wrote, \"It stops. Then it starts again.\" and closed the ticket.", "(See sec. 32.8 of the notes.)", "The run ended at 2 p.m.", "The note."], " "),
    (["Prof. J. R. Kerle of the Sorta Inst. asked for fig. 29 again.", "Was it 15.3 or 12.3?!", "Import finished 🎉", "The cold start took 10.6 ms.", "My left knee (cf. ch. 7) hurts…", "So he asked \"why me?\" and left.", "\"Leave it alone,\" said Ana, \"until v3.6.6 is out.\"", "Mr. A and Mrs. B agree, e.g. on Jan. 6 vs. Feb. 7."], " "),
    (["Ca. 4.3 km später war die 2. Runde vorbei.", "Er schrieb: „Es steht. Bitte warten.“ und ging.", "Am 9. März lief Nr. 47, d.h. zu kurz.", "Die S. 12 bzw. S. 7 fehlt noch.", "Das gilt bzgl. der Sicherung usw.", "Frau Dr. Bru nennt z.B. Version 0.17.6."], " "),
    (["Le n° 39 coûte 7,50 € ; est-ce trop ?", "Elle a noté : « Ça bloque. On relance. » puis rien.", "Le Pr. Aub vise la v. 7.9.4 etc.", "M. Dun et Mme Ruk ont lu env. 12 pages."], " "),
    (["Escribió: «Se para. Luego sigue.» y cerró.", "Véase p. ej. la fig. 46, la pág. 8, etc.", "¡Ya terminó la n.º 46!", "¿Por qué sale 27.9?", "EE. UU. queda fuera."], " "),
    (["彼は「止まった。もう一度やる。」と書いた。", "夜のあいだに止めた。", "Aubさん（担当者。再任）は確認した！", "版は8.1.2で、22.6秒だった。"], ""),
    (["一共77条。", "他写道：“停了。再试一次。”然后离开了。", "真的是31.9吗？", "Sell（见第30页。附录）已经核对过……", "Nev（见第1页。附录）已经核对过……", "版本是3.19.1。"], ""),
    (["В 36 г. проф. Quen ждал ок. 30.2 ч., т.е. долго.", "Нужны логи и т.д.", "Второй профиль.", "Она написала: «Стоит. Ждём.» и ушла."], " "),
    (["उसने लिखा, \"रुक गया। फिर चला।\" और चली गई।", "डॉ. Fal ने 12.0 घंटे इंतज़ार किया।", "क्या यह 6.9 है?", "सोमवार से॥"], " "),
    (["قال د. Kal إن المدة 36.3 ساعة.", "كتبت: «توقف. ثم عاد.» وأغلقت الصفحة.", "هل الرقم 6.5 صحيح؟", "الحساب."], " "),
    (["ทำไมต้องเป็น27.6", "งานกลางคืนแทนที่กุญแจ850ครั้ง", "บัญชีที่สอง"], " "),
    (["# A heading. With a stop", "A paragraph on\ntwo lines.", "- an item. With two", "* another", "```\ncode. More.\n\nx\n```", "User: a label stays. ".strip(), "Yes."], "\n"),
]


@pytest.mark.parametrize("parts, glue", CASES)
def test_cases(parts, glue):
    text = glue.join(parts)
    assert [text[s:e] for s, e in sentences(text)] == parts


def parts(text, lang=None):
    return [text[s:e] for s, e in sentences(text, lang)]


def test_abbreviations_act_in_their_language():
    assert parts("She lives on Main St. He left.") == ["She lives on Main St.", "He left."]
    assert parts("We met at St. Peter today. He left.") == ["We met at St. Peter today.", "He left."]
    assert parts("It was the work of Ing. The rest is in the file.") == ["It was the work of Ing.", "The rest is in the file."]
    assert parts("Das war für Ing. Maier und nicht mehr.") == ["Das war für Ing. Maier und nicht mehr."]
    assert parts("Ing. Maier", "de") == ["Ing. Maier"] and parts("Ing. Maier", "en") == ["Ing.", "Maier"]
    assert parts("Die Antwort ist das Abs. 3 nicht. Gut.", "en") == ["Die Antwort ist das Abs. 3 nicht.", "Gut."]  # the text tells, not the label


def test_line_and_paragraph_separators():
    assert parts("no stop\u2029next one") == ["no stop", "next one"]
    assert parts("a line\u2028goes on. Then.") == ["a line\u2028goes on.", "Then."]
    assert parts("# Head\r\nbody\r\n\r\nmore") == ["# Head", "body", "more"]


def test_blank_lines_always_end_one():
    text = "no stop here\n\n  \nand lower case"
    assert [text[s:e] for s, e in sentences(text)] == ["no stop here", "and lower case"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .?!…\n\"“”()«»。」「-#`🎉กข", max_size=120))
def test_every_character_belongs_to_one_sentence(text):
    spans = sentences(text)
    covered = [i for s, e in spans for i in range(s, e)]
    assert covered == sorted(set(covered))
    assert {i for i, c in enumerate(text) if not c.isspace()} <= set(covered)
    assert all(not text[s].isspace() and not text[e - 1].isspace() for s, e in spans)


def test_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", 0), (2, None, 0), (3, " \n ", 0), (1, "One. Two.", 0)], "doc_id long, text string, start_char int")
    assert sorted((r.doc_id, r.start_char) for r in sentence_table(df, "doc_id", "text").collect()) == [(1, 0), (1, 0), (1, 5), (1, 5)]
    assert sentence_table(df.limit(0), "doc_id", "text").count() == 0


def test_keys_pass_untouched(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(None, "A b."), (big, "C d. E f.")], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id, r.start_char) for r in sentence_table(df, "doc_id", "text").collect())
    assert got == [(False, None, 0), (True, big, 0), (True, big, 5)]
    with pytest.raises(ValueError):
        sentence_table(df.withColumnRenamed("doc_id", "start_char"), "start_char", "text")
