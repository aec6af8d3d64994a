"""Pinyin readings of Chinese characters, and the variants of a term.

The readings come from the ICU library on Spark's own class path, asked once on the driver; the
characters with several readings are listed here.  Both can be replaced by the caller.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

MAX_CHARS, MAX_POLYPHONIC_CHARS, MAX_VARIANTS, MAX_FULL_BYTES = 16, 4, 4, 48
FULL_PREFIX_LENGTHS, INITIALS_PREFIX_LENGTHS = (2, 16), (1, 16)

#: Common characters with more than one reading, the usual one first.
HETERONYMS = {
    k: tuple(v.split())
    for k, v in (
        x.split(":")
        for x in (
            "重:zhong chong;行:xing hang;长:zhang chang;乐:le yue;都:dou du;还:hai huan;得:de dei;地:di de;了:le liao;着:zhe zhao zhuo;"
            "参:can shen;藏:cang zang;朝:chao zhao;传:chuan zhuan;弹:dan tan;调:diao tiao;恶:e wu;会:hui kuai;系:xi ji;降:jiang xiang;"
            "校:xiao jiao;觉:jue jiao;角:jiao jue;卡:ka qia;壳:ke qiao;率:lv shuai;没:mei mo;模:mo mu;强:qiang jiang;色:se shai;"
            "厦:sha xia;什:shen shi;石:shi dan;宿:su xiu;尾:wei yi;吓:xia he;省:sheng xing;血:xue xie;叶:ye xie;仔:zi zai;择:ze zhai;"
            "扎:zha za;柏:bai bo;薄:bao bo;贾:jia gu;曾:zeng ceng;单:dan shan;解:jie xie;说:shuo shui;数:shu;车:che ju;差:cha chai ci;"
            "长:chang zhang;番:fan pan;否:fou pi;给:gei ji;合:he ge;和:he huo;红:hong gong;划:hua;圈:quan juan;咖:ka ga;落:luo la lao;"
            "绿:lv lu;南:nan na;弄:nong long;繁:fan po;便:bian pian;铺:pu;奇:qi ji;茄:qie jia;亲:qin qing;区:qu ou;任:ren;塞:sai se;"
            "盛:sheng cheng;识:shi zhi;适:shi kuo;熟:shu shou;提:ti di;拓:tuo ta;万:wan mo;无:wu mo;洗:xi xian;削:xiao xue;宁:ning;"
            "幺:yao;要:yao;员:yuan yun;约:yue yao;炸:zha;粘:zhan nian;折:zhe she;症:zheng;只:zhi;中:zhong;种:zhong chong;著:zhu zhuo;钻:zuan"
        ).split(";")
    )
}


def readings(spark: SparkSession, extra: dict[str, tuple[str, ...]] | None = None) -> dict[str, tuple[str, ...]]:
    """Every Chinese character's readings, the usual one first, in plain ASCII letters."""
    points = [*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000), *range(0xF900, 0xFB00)]
    ask = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Han-Latin; Latin-ASCII; Lower")
    found: dict[str, tuple[str, ...]] = {}
    answers = ask.transliterate("\n".join(map(chr, points))).split("\n")
    for point, answer in zip(points, answers):
        plain = answer.strip().replace(" ", "").replace("'", "")
        if plain.isascii() and plain.isalpha():
            found[chr(point)] = (plain,)
    for char, many in {**HETERONYMS, **(extra or {})}.items():
        found[char] = tuple(dict.fromkeys(many))
    return found


def variants(term: str, table: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """Distinct (full, initials) readings of a term, at most four, in order of readings.

    Terms of more than 16 characters have none, of more than four only the usual reading, and
    a term with an unknown character none."""
    options = [table.get(c) for c in term]
    if not term or len(term) > MAX_CHARS or any(o is None for o in options):
        return []
    if len(term) > MAX_POLYPHONIC_CHARS:
        options = [o[:1] for o in options]
    partial: list[tuple[str, str]] = [("", "")]
    for o in options:
        partial = list(dict.fromkeys((full + r, initials + r[0]) for full, initials in partial for r in o))
    fitting = [v for v in partial if len(v[0]) <= MAX_FULL_BYTES or len(term) > MAX_POLYPHONIC_CHARS]
    return fitting[:MAX_VARIANTS]


def prefixes(term: str, lengths: tuple[int, int]) -> list[str]:
    """Proper prefixes of an ASCII term, from the least to the greatest length allowed."""
    low, high = lengths
    return [term[:n] for n in range(low, min(high, len(term) - 1) + 1)] if term.isascii() else []
