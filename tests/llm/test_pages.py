"""Stuffed pages: pieces, the model against brute force, and held-out labels."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import pages as P

PROSE = "The council keeps the old bridge near the river. Although it was late, we saw how a teacher opens the gate. Who asked about the map that day?"
TAGS = " ".join(f"#garden{i} #cheaproof{i}" for i in range(40))
WORDS = " - ".join(["roof repair"] * 60)
LINKS = "\n".join(f"garden hose http://shop{i}.example/x?id={i}" for i in range(40))
RECORDS = "\n".join(f"{i} | Alma | Borin | {i}:{10 + i}" for i in range(1, 40))
MENU = "Home » Search » Login » Contact » News"


#: Plain prose and a list of keywords in languages that the tables don't hold.
OTHERS = {
    "ko": (
        "우리 마을의 오래된 다리는 강가에서 가장 아름다운 곳이다. 아침마다 아이들이 그 다리를 건너 학교에 간다. 어제는 비가 많이 내려서 물이 불어났지만 사람들은 걱정하지 않았다. 할머니는 시장에서 사과와 배를 사 오셨고 저녁에는 온 가족이 함께 밥을 먹었다. 선생님은 역사 수업에서 옛날 왕국에 대해 이야기해 주셨다. 그는 도서관에서 책을 빌려 밤늦게까지 읽었다.",
        "저렴한 지붕 수리, 지붕 수리 서울, 지붕 수리 가격, 최고의 지붕 수리, ",
    ),
    "hi": (
        "हमारे गाँव के पास एक पुराना पुल है जो नदी के ऊपर बना है। हर सुबह बच्चे उस पुल को पार करके विद्यालय जाते हैं। कल बहुत बारिश हुई और पानी बढ़ गया लेकिन लोगों ने चिंता नहीं की। दादी बाज़ार से सेब और केले लाईं और शाम को पूरा परिवार साथ बैठकर खाना खाया। शिक्षक ने इतिहास की कक्षा में पुराने राज्य के बारे में बताया। उसने पुस्तकालय से किताब ली और देर रात तक पढ़ता रहा।",
        "सस्ती छत मरम्मत, छत मरम्मत दिल्ली, छत मरम्मत कीमत, सबसे अच्छी छत मरम्मत, ",
    ),
    "th": (
        "สะพานเก่าของหมู่บ้านเราอยู่ริมแม่น้ำและเป็นสถานที่ที่สวยที่สุด ทุกเช้าเด็กๆ เดินข้ามสะพานนั้นไปโรงเรียน เมื่อวานฝนตกหนักจนน้ำขึ้นสูงแต่ผู้คนไม่ได้กังวล คุณยายซื้อแอปเปิลและกล้วยจากตลาด แล้วตอนเย็นทั้งครอบครัวก็กินข้าวด้วยกัน ครูเล่าเรื่องอาณาจักรโบราณในชั่วโมงประวัติศาสตร์ เขายืมหนังสือจากห้องสมุดและอ่านจนดึก",
        "ซ่อมหลังคาราคาถูก, ซ่อมหลังคากรุงเทพ, ราคาซ่อมหลังคา, ซ่อมหลังคาที่ดีที่สุด, ",
    ),
    "vi": (
        "Cây cầu cũ của làng chúng tôi nằm bên bờ sông và là nơi đẹp nhất. Mỗi buổi sáng trẻ em đi qua cây cầu đó để đến trường. Hôm qua trời mưa rất to nên nước dâng cao nhưng mọi người không lo lắng. Bà mua táo và chuối ở chợ rồi buổi tối cả gia đình cùng ăn cơm. Thầy giáo kể về vương quốc cổ trong giờ lịch sử. Anh ấy mượn sách ở thư viện và đọc đến khuya.",
        "sửa mái nhà giá rẻ, sửa mái nhà hà nội, giá sửa mái nhà, sửa mái nhà tốt nhất, ",
    ),
    "tr": (
        "Köyümüzün eski köprüsü nehrin kenarında ve en güzel yerdir. Her sabah çocuklar o köprüden geçerek okula gider. Dün çok yağmur yağdı ve su yükseldi ama insanlar endişelenmedi. Büyükannem pazardan elma ve muz aldı, akşam bütün aile birlikte yemek yedi. Öğretmen tarih dersinde eski krallıktan söz etti. O, kütüphaneden kitap ödünç aldı ve gece geç saatlere kadar okudu.",
        "ucuz çatı tamiri, çatı tamiri ankara, çatı tamiri fiyatı, en iyi çatı tamiri, ",
    ),
    "el": (
        "Η παλιά γέφυρα του χωριού μας βρίσκεται δίπλα στο ποτάμι και είναι το πιο όμορφο μέρος. Κάθε πρωί τα παιδιά περνούν τη γέφυρα για να πάνε στο σχολείο. Χθες έβρεξε πολύ και το νερό ανέβηκε αλλά οι άνθρωποι δεν ανησύχησαν. Η γιαγιά αγόρασε μήλα και μπανάνες από την αγορά και το βράδυ όλη η οικογένεια έφαγε μαζί. Ο δάσκαλος μίλησε για το αρχαίο βασίλειο.",
        "φθηνή επισκευή στέγης, επισκευή στέγης αθήνα, τιμή επισκευής στέγης, καλύτερη επισκευή στέγης, ",
    ),
    "bn": (
        "আমাদের গ্রামের পুরনো সেতুটি নদীর ধারে অবস্থিত এবং এটি সবচেয়ে সুন্দর জায়গা। প্রতিদিন সকালে শিশুরা সেই সেতু পার হয়ে বিদ্যালয়ে যায়। গতকাল অনেক বৃষ্টি হয়েছিল এবং জল বেড়ে গিয়েছিল কিন্তু মানুষ চিন্তা করেনি। দাদি বাজার থেকে আপেল ও কলা কিনেছিলেন। শিক্ষক ইতিহাসের ক্লাসে প্রাচীন রাজ্যের কথা বলেছিলেন।",
        "সস্তা ছাদ মেরামত, ছাদ মেরামত ঢাকা, ছাদ মেরামত মূল্য, সেরা ছাদ মেরামত, ",
    ),
    "it": (
        "Il vecchio ponte del nostro paese si trova vicino al fiume ed è il luogo più bello. Ogni mattina i bambini attraversano il ponte per andare a scuola. Ieri è piovuto molto e l'acqua è salita ma la gente non si è preoccupata. La nonna ha comprato mele e banane al mercato e la sera tutta la famiglia ha mangiato insieme. Il maestro ha parlato del regno antico durante la lezione.",
        "riparazione tetto economica, riparazione tetto roma, prezzo riparazione tetto, migliore riparazione tetto, ",
    ),
}


def test_pieces():
    p = P.pieces([None, "", "  \n\n ", "one two", "a " * 25, "漢字" * 20])
    assert set(p.page) == {3, 4, 5}
    assert np.bincount(p.page, p.words).tolist() == [0, 0, 0, 2, 25, 20]
    assert p.words.max() <= P.PIECE and p.symbols.min() >= 0 and p.symbols.max() < P.BINS
    assert len(P.pieces([]).page) == len(P.pieces([None]).page) == 0
    assert P.pieces(["Ab3" * 50_000]).words.sum() == 0  # an unbroken run has no words


def random_model(seed):
    r = np.random.default_rng(seed)
    norm = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return P.Model(norm(r.random(5)), norm(r.random((5, 5))), norm(r.random((P.FEATURES, 5, P.BINS))), 0.5, 20)


def test_label_and_expectations_against_all_paths():
    r = np.random.default_rng(1)
    for seed in range(3):
        m = random_model(seed)
        page = np.repeat([0, 1, 3], [4, 1, 3])
        p = P.Pieces(page, np.ones(8), r.integers(0, P.BINS, (8, P.FEATURES)).astype(np.int8), np.zeros(8))
        score, states = m.scores(p.symbols), P.label(m, p)
        weight, start, move = P._expected(m, p, np.zeros((8, 5)))
        total_start = np.zeros(5)
        for k in (0, 1, 3):
            rows = np.flatnonzero(page == k)
            paths = list(itertools.product(range(5), repeat=len(rows)))
            logs = [m.start[s[0]] + sum(m.move[a, b] for a, b in zip(s, s[1:])) + sum(score[i, x] for i, x in zip(rows, s)) for s in paths]
            assert tuple(states[rows]) == paths[int(np.argmax(logs))]
            odds = np.exp(np.array(logs) - max(logs))
            odds /= odds.sum()
            for at, i in enumerate(rows):
                mine = [sum(o for o, s in zip(odds, paths) if s[at] == x) for x in range(5)]
                assert np.allclose(weight[i], mine)
                if at == 0:
                    total_start += mine
        assert np.allclose(start, total_start) and np.isclose(move.sum(), 5)


@pytest.fixture(scope="module")
def labelled():
    con = duckdb.connect()
    d = "/root/testdata/sf0.1"
    return con.execute(
        f"select text, avg(stuffed) > 0.5 from '{d}/pagelabels.parquet' join '{d}/documents.parquet' using (doc_id) where stuffed is not null group by doc_id, text having avg(stuffed) <> 0.5 order by doc_id"
    ).fetchall()


def test_held_out_labels(labelled):
    """Half of the pages fit the model, the other half test it; raters err, so not all can agree."""
    half = len(labelled) // 2
    train, test = labelled[:half], labelled[half:]
    m = P.fit(P.pieces([t for t, _ in train]), np.array([y for _, y in train]))
    p = P.pieces([t for t, _ in test])
    share, words = P.listed(P.label(m, p), p, len(test))
    hit, y = (share >= m.share) & (words >= m.least), np.array([y for _, y in test])
    assert (hit == y).mean() > 0.9
    made = [PROSE * 6, TAGS, WORDS, LINKS, RECORDS, f"{MENU}\n{PROSE * 3}\n" + " ".join(TAGS.split()[:6]), f"{MENU}\n{PROSE}\n{WORDS}"]
    p = P.pieces(made)
    share, words = P.listed(P.label(m, p), p, len(made))
    assert ((share >= m.share) & (words >= m.least)).tolist() == [False, True, True, True, False, False, True]


@pytest.fixture(scope="module")
def sure():
    """Pages of which several raters say the same."""
    d = "/root/testdata/sf0.1"
    return duckdb.sql(
        f"select text, avg(stuffed) > 0.5 from '{d}/pagelabels.parquet' join '{d}/documents.parquet' using (doc_id) where stuffed is not null group by doc_id, text having count(*) > 1 and min(stuffed) = max(stuffed) order by doc_id"
    ).fetchall()


def test_held_out_pages_that_raters_agree_on(labelled, sure):
    agreed = {t for t, _ in sure}
    m = P.fit(P.pieces([t for t, _ in labelled if t not in agreed]), np.array([y for t, y in labelled if t not in agreed]))
    p = P.pieces([t for t, _ in sure])
    share, words = P.listed(P.label(m, p), p, len(sure))
    hit, y = (share >= m.share) & (words >= m.least), np.array([y for _, y in sure])
    assert y.sum() > 20 and (hit & y).sum() / y.sum() > 0.95 and (hit & y).sum() / hit.sum() > 0.95


def test_other_languages(labelled):
    """Prose in scripts and languages without known function words isn't stuffed; keywords in them are, with sentences beside them too."""
    m = P.fit(P.pieces([t for t, _ in labelled]), np.array([y for _, y in labelled]))
    for name, (prose, keywords) in OTHERS.items():
        made = [prose, keywords * 12, f"{prose}\n{keywords * 12}"]
        p = P.pieces(made)
        share, words = P.listed(P.label(m, p), p, len(made))
        assert ((share >= m.share) & (words >= m.least)).tolist() == [False, True, True], name


def test_words_of_other_scripts_stay_whole():
    kinds = [t for t in P.TOKEN.findall("विद्यालय में পুরনো สะพานเก่า 우리 마을 العَرَبِيَّة naïve e\u0301te\u0301") if t.strip()]
    assert kinds == ["विद्यालय", "में", "পুরনো", "สะพานเก่า", "우리", "마을", "العَرَبِيَّة", "naïve", "e\u0301te\u0301"]


def test_find(spark, labelled):
    rows = [(i, t) for i, (t, _) in enumerate(labelled[:200])] + [(1000, None), (1001, ""), (1002, TAGS), (1003, TAGS), (1004, PROSE * 4000), (1005, MENU)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("share", F.lit("x")).repartition(3)
    labels = [(i, r, int(y)) for i, (_, y) in enumerate(labelled[:200]) for r in (1, 2)] + [(1002, 1, None), (5, 3, None), (99999, 1, 1), (1004, 1, 1), (1004, 2, 0)]
    votes = spark.createDataFrame(labels, "doc_id bigint, rater int, stuffed int")
    m = P.train(docs, votes)
    got = {r["doc_id"] for r in P.find_stuffed(docs, m).collect()}
    assert {1002, 1003} <= got and not {1000, 1001, 1004, 1005} & got
    bare = P.train(docs, votes.limit(0))
    assert {1002, 1003} <= {r["doc_id"] for r in P.find_stuffed(docs, bare).collect()}
    none = P.train(docs.limit(0), votes.limit(0))
    assert P.find_stuffed(docs.limit(0), none).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "'some words' as text")
    votes = spark.range(50).selectExpr("id as doc_id", "1 as rater", "cast(id % 2 as int) as stuffed")
    taken = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(10)
    assert P.sample_pieces(docs.join(taken, "doc_id", "left_semi"))[0].page.max() == 9
    assert P.train(docs, votes, sample=10).least > 0
