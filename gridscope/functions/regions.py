"""Names of Japanese prefectures and municipalities; a larger dictionary can be given as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The prefectures in the order of their JIS X 0401 codes 01 to 47.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 "
    "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
#: Seats of prefectures, designated and larger cities, and the special wards.
MUNICIPALITIES = (
    "札幌市 函館市 旭川市 青森市 八戸市 盛岡市 仙台市 秋田市 山形市 福島市 郡山市 いわき市 水戸市 宇都宮市 前橋市 高崎市 さいたま市 川越市 川口市 越谷市 千葉市 船橋市 柏市 八王子市 "
    "横浜市 川崎市 相模原市 横須賀市 新潟市 富山市 金沢市 福井市 甲府市 長野市 松本市 岐阜市 静岡市 浜松市 名古屋市 豊橋市 岡崎市 豊田市 津市 四日市市 大津市 京都市 大阪市 堺市 豊中市 "
    "高槻市 枚方市 東大阪市 神戸市 姫路市 尼崎市 西宮市 奈良市 和歌山市 鳥取市 松江市 岡山市 倉敷市 広島市 呉市 福山市 山口市 下関市 徳島市 高松市 松山市 高知市 北九州市 福岡市 久留米市 "
    "佐賀市 長崎市 佐世保市 熊本市 大分市 宮崎市 鹿児島市 那覇市 "
    "千代田区 中央区 港区 新宿区 文京区 台東区 墨田区 江東区 品川区 目黒区 大田区 世田谷区 渋谷区 中野区 杉並区 豊島区 北区 荒川区 板橋区 練馬区 足立区 葛飾区 江戸川区"
).split()


def entries() -> list[tuple[str, str]]:
    """(name, kind): pref and city are full names, the others what is left without the ending."""
    short = [(n[:-1], "pref_short") for n in PREFECTURES if n != "北海道"]
    alias = [(n[:-1], "city_alias") for n in MUNICIPALITIES if len(n) > 2]
    return [(n, "pref") for n in PREFECTURES] + short + [(n, "city") for n in MUNICIPALITIES] + alias


def dictionary(spark: SparkSession) -> DataFrame:
    """(name, full, short, alias): what a name may be."""
    kinds: dict[str, set[str]] = {}
    for name, kind in entries():
        kinds.setdefault(name, set()).add(kind)
    rows = [(n, bool(k & {"pref", "city"}), "pref_short" in k and "pref" not in k, "city_alias" in k and "city" not in k) for n, k in sorted(kinds.items())]
    return spark.createDataFrame(rows, "name string, full boolean, short boolean, alias boolean")
