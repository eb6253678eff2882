import pytest

from tessera.llm.encoding import Lengths, count_tokens, excerpt, garbled_texts, looks_lost, repair, train_dictionaries
from tessera.session import read_table

CLEAN = {
    "ko": ["청소원은 셔터를 들고 있고 뒤쪽에는 부서진 전동휠이 서 있다.", "왼쪽 사물함 말고 오른쪽 바구니를 기준으로 세어야 한다.", "비에 젖은 소화전이 운동장 바닥에 비친다."],
    "fr": ["Près du dépôt, une étagère abîmée gêne l’entrée.", "Étiquette vérifiée : la barrière reste séparée du quai.", "Le gardien déplace la bâche après la relève."],
    "es": ["Mañana se añade otra señal según el guión.", "¿Dónde está la grúa del jardín? Aparece allí."],
    "pt": ["SEÇÃO 3: LIGAÇÃO ENTRE armazém E balcão EM CONSTRUÇÃO.", "A lâmpada fica atrás do galpão e não aparece."],
    "ru": ["Камера снимает причал после дождя.", "Сторож переносит ящик к воротам."],
    "ja": ["作業員が北門で看板を片付けている。", "写真では棚が発電機に隠れている。"],
    "vi": ["Nhãn biển báo đã được sửa ở chợ cá.", "Ảnh có hàng rào đặt cạnh bãi đỗ."],
    "en": ["It’s the van on the left that counts, not the pylon.", "Search for “net near gate” returned 60 images – all of them.", "Order slip £13 / ¥23 pinned to the mirror.", "Dust of 72 µm ± 2 (§ 93). 🙂 ★ α → ½", "Kanalnamn: ÅÄÖ 43, señal ñ 42."],
}
ALL = [t for ts in CLEAN.values() for t in ts]
TRAIN = [f"{t} {u}" for t in ALL for u in ALL]


@pytest.fixture(scope="module")
def lengths():
    counts = count_tokens(TRAIN)
    return Lengths(train_dictionaries([x for t in TRAIN for x in excerpt(t, 0, 2000)]), counts)


@pytest.mark.parametrize("text", ALL)
def test_proper_text_stays(lengths, text):
    assert repair(text, lengths)[:2] == (text, [])


def garble(text, right, wrong):
    return text.encode(right).decode(wrong)


@pytest.mark.parametrize("language, right, wrong", [("ko", "utf-8", "latin-1"), ("ko", "cp949", "latin-1"), ("ko", "utf-8", "mac_roman"), ("ko", "utf-8", "cp437"), ("fr", "utf-8", "latin-1"), ("es", "utf-8", "latin-1"), ("ru", "utf-8", "latin-1"), ("ru", "cp866", "cp1251"), ("ru", "cp1251", "koi8-r"), ("ja", "utf-8", "latin-1"), ("vi", "utf-8", "latin-1"), ("fr", "cp1252", "mac_roman"), ("en", "utf-8", "cp437"), ("pt", "utf-8", "mac_roman")])
def test_round_trip(lengths, language, right, wrong):
    for text in CLEAN[language]:
        try:
            bad = garble(text, right, wrong)
        except UnicodeError:
            continue
        if bad == text:
            continue
        assert repair(bad, lengths)[0] == text, bad


def test_twice_and_in_part(lengths):
    text = CLEAN["ko"][0]
    twice = garble(garble(text, "utf-8", "latin-1"), "utf-8", "latin-1")
    assert repair(twice, lengths)[0] == text
    mixed = CLEAN["pt"][0] + " " + garble(text, "utf-8", "latin-1") + " " + CLEAN["en"][0]
    assert repair(mixed, lengths)[0] == CLEAN["pt"][0] + " " + text + " " + CLEAN["en"][0]


def test_lost_characters():
    assert looks_lost("It�s a van") and looks_lost("����몴 x") and not looks_lost("cut in a chara�") and not looks_lost("fine")


def test_table(spark):
    bad = garble(CLEAN["ko"][0], "utf-8", "latin-1")
    rows = [(i, t) for i, t in enumerate(TRAIN)] + [(1000, bad), (1000, bad), (1001, None), (1002, ""), (1003, "It�s a van"), (None, bad), (1004, (CLEAN["fr"][0] + " ") * 3000 + bad), (1005, "plain ascii")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "folder_id long, sidecar_text string, id string, text string")
    got = {r["id"]: r for r in garbled_texts(df, "folder_id", "sidecar_text").collect()}
    assert set(got) == {1000, 1003, 1004}
    assert got[1000]["original"] == CLEAN["ko"][0] and got[1000]["recovered"] and not got[1003]["recovered"]
    assert got[1004]["original"].endswith(CLEAN["ko"][0])
    assert garbled_texts(df.limit(0), "folder_id", "sidecar_text").count() == 0


def test_accuracy_on_garbled_rows_of_the_test_table(spark, data):
    rows = read_table(spark, data.replace("sf0.001", "sf0.01"), "leaf_folders").filter("sidecar_text <> ''").select("sidecar_text").distinct()
    texts = [r[0] for r in rows.collect()]
    counts = count_tokens(texts)
    fit = Lengths(train_dictionaries([x for t in texts for x in excerpt(t, 0, 2000)]), counts)
    clean = [t for t in texts if not t.isascii() and repair(t, fit)[0] == t and "�" not in t]
    right = total = 0
    for t in clean:
        bad = t.encode().decode("latin-1")
        total += 1
        right += repair(bad, fit)[0] == t
    assert total > 200 and right >= 0.95 * total


def test_words_outside_the_sample_count(spark):
    """What the sample of the dictionaries leaves out, or cuts off, is known all the same."""
    words = "мельница пристань лестница фонарь сторож".split()
    clean = [" ".join(["мельницы пристани лестницы фонари сторожа", *["pier"] * 600, *words]) + f" {i}" for i in range(30)]
    bad = "The note reads " + " ".join(words).encode("cp1251").decode("cp1252")
    df = spark.createDataFrame(list(enumerate([bad, *clean])), "id long, text string")
    for sample in (5, 20_000):
        got = {r["id"]: r["original"] for r in garbled_texts(df, "id", "text", sample=sample).collect()}
        assert got == {0: "The note reads " + " ".join(words)}
