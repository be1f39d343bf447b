"""Problems 5 and 7: one form for look-alike text, and wrong encodings."""

import re
import unicodedata as U

import pytest
from pyspark.sql import functions as F

from wordtide.functions.patterns import PAYLOAD_MARKER
from wordtide.llm import encoding_repair as ER
from wordtide.llm import normal_form as NF

# Rows of which all texts look the same.
FAMILIES = [
    ["café au lait", "cafe\u0301 au lait", "ｃａｆé　ａｕ　ｌａｉｔ", "c\u0430f\u00e9 \u0430u lait", "ca\u200bf\u00e9\u00a0au\u2009lait", "caf\u00e9 au\ufeff lait"],
    ["각자 간다", U.normalize("NFD", "각자 간다")],
    ["ガラス", "ｶﾞﾗｽ", "カ\u3099ラス"],
    ["a\u0323\u0301", "a\u0301\u0323", "\u1ea1\u0301"],
    ["ещё", "еще\u0308"],
    ["हिन्दी क़", "हिन्दी \u0958"],
]
DIFFERENT = ["Café au lait", "cafe au lait", "café au lait!", "café au  lait", "café\nau lait", "ﬁn", "fin", "x²", "x2", "I", "l", "1"]


@pytest.mark.parametrize("family", FAMILIES, ids=range(len(FAMILIES)))
def test_one_form(family):
    assert len({NF.normal(t) for t in family}) == 1
    assert NF.normal(NF.normal(family[0])) == NF.normal(family[0])


def test_differences_stay():
    forms = [NF.normal(t) for t in [FAMILIES[0][0], *DIFFERENT]]
    assert len(set(forms)) == len(forms)


def test_patterns_miss_no_character():
    def python(p):
        return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), p.replace(r"\xa0", "\xa0").replace(r"\xad", "\xad").replace(r"\p{M}", "")))

    joins, changes = python(NF.MAY_JOIN), python(NF.MAY_CHANGE)
    assert [c for c in NF.joining() if U.category(c)[0] != "M" and not joins.match(c)] == []
    assert [c for c in NF._single() if U.category(c)[0] != "M" and not changes.match(c)] == []


def test_operator_equals_plain_python(spark):
    texts = [t for f in FAMILIES for t in f] + DIFFERENT + [None, "", "́start", "x" * 50_000 + "é", "👩\u200d🍳", "i\u0307İ"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(900, texts[0], "k")], "id int, text string, k1 string").withColumn("at", F.lit(1))
    got = {r.id: r for r in NF.normalise(df, "text").collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert got[i].form == (None if t is None else NF.normal(t)) and got[i].k1 == "k"
    assert NF.normalise(df.where("false"), "text").collect() == []


def test_pairs(spark):
    texts = [*FAMILIES[0], FAMILIES[0][0], *DIFFERENT, None, None, "", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, desc string").withColumn("k1", F.lit(0)).withColumn("text", F.lit("z"))
    got = sorted((r.a, r.b) for r in NF.look_alikes(df, "row_id", "desc").collect())
    alike = range(7)
    assert got == [(i, j) for i in alike for j in alike if i < j and texts[i] != texts[j]]
    assert NF.look_alikes(df.where("false"), "row_id", "desc").collect() == []


ORIGINALS = ["Así es como llevé la mañana, ¿quién más?", "Не пропустите песню, это очень тёплый момент", "昨日の夜に静かなコーヒーを作りました", "정말 따뜻한 영상이니까 놓치지 마세요", "هكذا فتحنا النافذة مع الدراجة", "it’s here… “now” 🎶"]


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp866", "cp850"])
def test_round_trip_utf8(codec):
    for text in ORIGINALS:
        garbled = ER._read(text.encode(), codec)
        assert ER.restore(garbled)[:1] == (text,), (codec, garbled)
        mixed = f"proper text {garbled}"
        assert ER.restore(mixed)[0] == f"proper text {text}"


def test_round_trip_twice():
    for text in ORIGINALS[:2]:
        assert ER.restore(ER._read(ER._read(text.encode(), "cp1252").encode(), "cp1252"))[0] == text


@pytest.mark.parametrize(
    ("source", "taken", "text"),
    [
        ("cp1251", "cp1252", "сегодня мы нашли велосипед и мост"), ("euc_jp", "latin-1", "とても静かなランプなので見逃さないでくださいね"), ("shift_jis", "cp1252", "これが小さい庭と上着の使い方です"),
        ("cp949", "cp1252", "또 누가 빵을 일요일마다 좋아하나요"), ("cp1252", "cp850", "não perca o coração, está muito bonita"), ("cp1252", "cp1251", "Je n’ai jamais dansé avec la fenêtre"),
        ("cp1254", "cp1252", "işte böyle şarkıyı ile çiçeği birlikte"), ("koi8-r", "cp1251", "Вот как мы приготовили сад вместе"),
    ],
)
def test_other_pairs(source, taken, text):
    restored, spans, lost = ER.restore(ER._read(text.encode(source), taken))
    same = sum(a == b for a, b in zip(restored, text, strict=False)) / len(text)
    assert spans and not lost and same > 0.9, restored


@pytest.mark.parametrize("codec", ["cp1251", "koi8-r"])
def test_accents_that_show_as_look_alikes(codec):
    """Words whose Latin letters are all like Cyrillic ones, and foreign letters that are like Latin ones beside others."""
    for text in ("hoje com muita emoção", "mi mamá dice más", "la montaña es única", "verpasst nicht die Küche, das ist schön", "quem levou a mãe, porque não deu", "voilà la forêt"):
        assert ER.restore(ER._read(text.encode("cp1252"), codec))[0] == text
    for text in ("wе јuѕt lооk", "This іs how my ѕіstеr todaу", "Κardeşim sο", "To былo тиxo", "YouTubeе смотрите видео на канале", "МacТep и Maрина"):
        assert ER.restore(text) == (text, 0, False)


PROPER = [
    "plain", "", "NÃO PERCA A MANHÃ, ESTÁ MUITO RÁPIDA", "IRMÃ\xa0NÃO", "É\xa0assim que", "Voilà « tout »", "ВПЕРЁД И ЕЩЁ ЦВЕТОК", "кто ещё цветок любит?", "¿Qué? ¡Sí!", "Straße über",
    "Ağır İş ÇIĞ", "wе\xa0јuѕt lооk", "краcивый мoмeнт", "caf\u00e9’s “quote”", "25°C ±2 ½", f"text {PAYLOAD_MARKER}*\x08 rest", "こんにちは", "हिन्दी", "2 × 3 → 5 ✨", "l’été à Orléans",
]


def test_proper_text_is_left():
    for text in PROPER:
        assert ER.restore(text) == (text, 0, False)


def test_repair(spark):
    rows = [(1, "maÃ±ana"), (2, "caf\ufffd"), (3, None), (4, ""), (5, f"x {PAYLOAD_MARKER}z"), (6, "maÃ±ana"), (7, "ok " * 30_000 + "Ã©")]
    df = spark.createDataFrame(rows, "row_id int, desc string").withColumn("spans", F.lit("own"))
    got = {r.row_id: (r.repaired.restored, r.repaired.spans, r.repaired.lost, r.spans) for r in ER.repair(df).collect()}
    assert got[1] == got[6] == ("mañana", 1, False, "own") and got[2] == ("caf\ufffd", 0, True, "own") and got[3] == (None, 0, False, "own")
    assert got[4][0] == "" and got[5] == (rows[4][1], 0, False, "own") and got[7][0].endswith("é")
    assert sorted(r.row_id for r in ER.garbled_rows(df).collect()) == [1, 2, 6, 7]
    assert ER.repair(df.where("false")).collect() == []
