import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.sentences import Trie, lattice, sentences, split_sentences

CASES = [
    ["Dr. van Hale of St. Mary Hospital said the rate rose to 28.23 percent in May.", "It was empty!", "eVolta shares fell 5.3 points."],
    ["“Will it last?” asked Ann Lee.", "“Stop it!” shouted a clerk.", "“We did not expect it,” said Bo."],
    ["Mr. Lee, a.k.a. the king, closed No. 301 on the list.", "The report (see p. 12, fig. 3) lists it.", "It moved to Acme Holdings Ltd.", "Prices went up, i.e. faster than that."],
    ["Officials at Rail Co. and Freight Inc. met at 10.30 a.m. on Friday.", "They left before 7 p.m.", "V.K. Poe closed it alone?!", "Why?"],
    ["Talks dragged on … and the council left.", "Then came Monday."],
    ["Am 16. Oktober belastet die Wahl die Stadt.", "Viele Orte, z. B. Bonn, warten.", "Straßen, Schulen usw.", "„Das war nicht der Plan“, sagte Eva.", "Es dauert seit 2023.", "Der Anteil stieg auf 29,7 Prozent, d. h. stärker."],
    ["M. Petit a dit non.", "« Faut-il partir ? » demande Ève à Lyon.", "Quelle surprise !", "On trouve des ponts, des écoles, etc.", "« Ce n’est pas fini », a dit Luc."],
    ["El Dr. Paz visitó Lima el 5 de mayo.", "¡Qué sorpresa!", "¿Por qué?", "Faltan puentes, trenes, etc.", "En EE. del Norte, p. ej. en Boa, la empresa S.A. crece."],
    ["Там строят мосты, школы и т. д.", "Проф. Орлов сказал, что порт стоит 64,1 млн. рублей в год.", "Дом на ул. Мира, д. 245, закрыт, т. е. Пелград ждёт.", "«Кто заплатит?» — спросил А. К. Мишин.", "В 2026 г. рынок радует всех."],
    ["قال د. كريم إن التكلفة 44.3 مليون.", "راجع ص. 233 من التقرير.", "«من يدفع؟» سأل سالم.", "منذ عام 2014، يغير كلها؛ وهذا لا يكفي."],
    ["डॉ. वेदनाथ ने कहा कि खर्च 49.3 करोड़ होगा।", "“कौन देगा?” राय ने पूछा।", "लंबा पुल बंद है!"],
]


@pytest.mark.parametrize("parts", CASES)
def test_spaced_scripts(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["岳若川在石桥湾说：“预算不会停。”", "“谁来付钱？”林望舟问道。", "比例升至28.28%，高于平均。", "会议拖了很久……码头终于开了。", "整个石桥湾！"],
        ["「誰が払うのですか？」と柚原さんが尋ねた。", "会議は続き……図書館が驚かせた。", "なぜ閉じたのか？", "「準備はない。」と白樫氏は語った。"],
    ],
)
def test_scripts_without_spaces(parts):
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_thai():
    parts = ["คุณลูนาบอกว่าตลาดท้องถิ่นต้องใช้เงิน 44.9 ล้านบาท", "ตั้งแต่ปี 2035 กฎหมายใหม่ช่วยชาวเมืองเวลมา", "ทำไมท่าเรือเก่าจึงปิด", "ชาวเกาะเพลารอสะพานไม้มานาน"]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_blocks_lines_and_missing_blanks():
    text = "A Heading Without Stop\n \n- A list line, explained\n\n* * *\n\nIt was\nwrapped here. Next one.It had no blank.\r\n\r\nEnd"
    assert [text[a:b] for a, b in sentences(text)] == ["A Heading Without Stop", "- A list line, explained", "* * *", "It was\nwrapped here.", "Next one.", "It had no blank.", "End"]


@settings(max_examples=300, deadline=None)
@given(st.text("aB. !?…\n\"“”«»»()，。？」「ก ๆ।;-1", max_size=60))
def test_sentences_cover_the_text_in_order(text):
    at = 0
    for a, b in sentences(text):
        assert a < b and text[at:a].strip() == "" and text[a:b] == text[a:b].strip()
        at = b
    assert text[at:].strip() == ""


@pytest.mark.parametrize("text", ["!" * 60 + "x", "." * 100_000 + "x", "a" * 300_000, " " * 300_000, "«" * 3000 + ". A", "。" * 50_000, "ก " * 10_000, "A. " * 20_000])
def test_long_runs_take_no_time(text):
    sentences(text)


def test_word_lattice_prefers_known_and_few_words():
    words = Trie(["ab", "abc", "cd", "d"])
    assert lattice("abcd", 0, 4, words) == [(0, 3, True), (3, 4, True)] or lattice("abcd", 0, 4, words) == [(0, 2, True), (2, 4, True)]
    assert lattice("xxabxx", 0, 6, words) == [(0, 2, False), (2, 4, True), (4, 6, False)]
    assert lattice("", 0, 0, words) == []


def test_rows(spark):
    df = spark.createDataFrame([(1, "Aa bb. Cc dd.", 5), (1, "Aa bb. Cc dd.", 5), (2, None, 5), (3, "", 5), (4, "  \n ", 5)], "id long, t string, start_pos int")
    assert sorted(map(tuple, split_sentences(df, "id", "t").collect())) == [(1, 0, 6), (1, 0, 6), (1, 7, 13), (1, 7, 13)]
    assert split_sentences(df.limit(0), "id", "t").count() == 0


@pytest.mark.parametrize("n", [2, 3, 10])
@pytest.mark.parametrize("marks", ["“”", '""', "«»", "»«", "„“"])
def test_a_quotation_of_many_sentences_stays_in_its_sentence(n, marks):
    quoted = " ".join(f"It is day {'ABCDEFGHIJ'[i]}x." for i in range(n - 1)) + " Go home,"
    parts = ["The day was long.", f"He said, {marks[0]}{quoted}{marks[1]} and left.", "Nobody went.", f"{marks[0]}Why?{marks[1]} Bo asked."]
    text = " ".join(parts[:3])
    assert [text[a:b] for a, b in sentences(text)] == parts[:3]


@pytest.mark.parametrize("n", [3, 10])
def test_a_quotation_of_many_sentences_without_spaces(n):
    for parts in (["会议很长。", "他说：“" + "今天不行。" * n + "明天再来”，然后离开。", "没有人走。"], ["会議は長い。", "彼は「" + "今日はだめだ。" * n + "明日来て」と言った。", "誰も帰らない。"]):
        text = "".join(parts)
        assert [text[a:b] for a, b in sentences(text)] == parts


def test_only_unbalanced_quotations_are_split():
    parts = ["He said, “It is late.", "We are tired.", "Go home and sleep.", "She wrote “One. Two. Three” twice.", "It rained."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts
    parts = ["A 5\" pipe broke.", "He said \"Go. Run. Now\" again.", "Then it held."]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts
    parts = ["他说：“今天不行。", "明天再来。", "没有人走。"]
    text = "".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_a_sentence_may_pass_over_many_weak_nodes():
    text = "He waited " + "… and waited " * 12 + "for long. Then he left."
    assert [text[a:b] for a, b in sentences(text)] == [text[:-14], "Then he left."]
    sentences("“A. " * 20_000 + "«(B. " * 20_000)


@pytest.mark.parametrize(
    "parts",
    [
        ["คุณลูนา คุณเวดนา และคุณทามินไม่เห็นด้วยกับท่าเรือเก่า", "ทำไมตลาดท้องถิ่นจึงปิด"],  # a list of names
        ["ตลาดท้องถิ่นขายผัก ผลไม้ และปลา", "ชาวเกาะเพลารอสะพานไม้มานาน"],  # list items
        ["คุณลูนาบอกว่า ท่าเรือเก่าต้องใช้เงิน 44.9 ล้านบาท", "ท่าเรือเก่าสร้างปัญหาให้ท่าดอรัน"],  # a word that leaves it open
        ["ท่าเรือเก่าจะปิด เพราะสะพานไม้สร้างปัญหา", "กฎหมายใหม่ช่วยเมืองเวลมา", "กฎหมายใหม่ทำให้ตกใจ"],  # a conjunction; no sign at all
        ["ดีมากค่ะ", "ตลาดใหม่เปิดครับ", "ผักสด"],  # final particles
        ["ดีมาก ตลาดใหม่เปิด"],  # the same without one
    ],
)
def test_thai_blanks_inside_and_between_sentences(parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


@pytest.mark.parametrize(
    "text, parts",
    [
        ("They climbed Mt. Everest in May. It was cold.", 2),
        ("He came on Jan. 5 and left. She stayed.", 2),
        ("ខ្ញុំទៅផ្សារ។ គាត់នៅផ្ទះ។", 2),
        ("ကျွန်ုပ်သွားသည်။ သူနေသည်။", 2),
        ("ຂ້ອຍໄປຕະຫຼາດ ລາວຢູ່ເຮືອນ", 1),
        ("“天气很冷。”记者王小明在现场透露。我们走吧。", 2),
    ],
)
def test_more_abbreviations_and_terminators(text, parts):
    assert len(sentences(text)) == parts


def test_a_quotation_is_looked_for_however_far_back():
    inner = "क " * 3000
    text = "उसने कहा, “" + inner + "अंत।” वह गया।"
    assert sentences(text) == sentences(text.replace(inner, inner)) and len(sentences(text)) == len(sentences("उसने कहा, “" + "क " * 3 + "अंत।” वह गया।"))
