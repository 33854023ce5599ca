"""Pages decoded by a wrong charset: their text comes back, and they are judged as all others."""

import numpy as np
import pytest

from siltstone.llm import pages as P
from siltstone.llm.charsets import undone

RU = "Сайт хранит файлы. Хотя было поздно, учитель открывает старый мост у реки, и мы видели это по карте."
JA = "当サイトはクッキーを使用します。なぜ古い橋は庭を直しますか。先生の図書館は静かな夏です。"
AR = "هذا المحطة الأخضر يجد النافذة في عام بعيد. لماذا يصلح المكتبة القديم الحديقة على التي عند البيت"
ZH = "明亮的工厂慢慢地找到冬天。为什么博物馆收集沉重的河流?安静的问题是有用的天气。"


@pytest.mark.parametrize("text,true,false", [(RU, "utf-8", "latin-1"), (RU, "cp1251", "cp1252"), (RU, "koi8-r", "latin-1"), (RU, "utf-8", "cp1251"), (JA, "utf-8", "latin-1"), (JA, "euc_jp", "iso-8859-2"), (AR, "utf-8", "iso-8859-2"), (ZH, "gb18030", "latin-1")])
def test_undone(text, true, false):
    assert undone(text.encode(true).decode(false, "replace"), P.GLUE) == text


def test_others_stay():
    assert all(undone(t, P.GLUE) == t for t in (RU, JA, AR, ZH, "Ça n'est pas très élevé", "Zażółć gęślą jaźń, że się nie", "", "\xa0", "�" * 40))


def tags(place):
    return " | ".join(f"холодный займ онлайн {place}{i}" for i in range(40))


def test_lists_in_a_wrong_charset_are_found():
    made = [tags("Киев"), RU * 8, "Главная » Поиск\n" + RU * 6, "�" * 400 + " | tag" * 30]
    m = P.fit(P.pieces([*made[:2] * 20]), np.array([True, False] * 20))
    for true, false in (("utf-8", "latin-1"), ("utf-8", "cp1252"), ("cp1251", "latin-1"), ("utf-8", "iso-8859-2")):
        texts = [t.encode(true).decode(false, "replace") for t in made[:3]] + made[3:]
        p = P.pieces(texts)
        share, words = P.listed(P.label(m, p), p, len(texts))
        assert ((share >= m.share) & (words >= m.least)).tolist() == [True, False, False, False], (true, false)
