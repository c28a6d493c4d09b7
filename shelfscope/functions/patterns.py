"""Unit words, separators and other words results depend on."""

# Fixed values.  Order matters, since regex alternation takes the first hit.
CAPACITY_UNITS = "mL|ml|kg|L|g|m|枚|本|個|袋|巻|回|粒|包|錠|日"
BASE_UNITS = CAPACITY_UNITS + "|組"
PACK_UNITS = "ロール|パック|セット|箱|缶|ケース"
ANY_UNIT = CAPACITY_UNITS + "|" + PACK_UNITS
TIMES = "×xX*＊"
NUMBER = r"[\d,]+(?:\.\d+)?"
SALES_UNITS = "枚|個|本|袋|セット|パック|箱|ケース"
MEASURE_UNITS = "mL|ml|L|g|kg"
VARIANT_UNITS = "枚|個|本|袋|セット|パック|箱|ケース|ロール|組"
VARIANT_DELIMITERS = ",，、/／・"

# White space including the ideographic space, which Java's \s leaves out.
WS_SET = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = "[" + WS_SET + "]"
# End of a Latin word; Java counts Japanese letters as word characters.
WORD_END = r"(?![A-Za-z0-9_])"
WORD_START = r"(?<![A-Za-z0-9_])"

# Words that make a pack size doubtful.
AMBIGUOUS_TERMS = [
    "選べる", "選択", "セット", "詰め合わせ", "詰合せ", "本体+詰替", "本体＋詰替",
    "本体 詰替", "詰替", "お試し", "各種", "サイズ選択", "バリエーション",
    "アソート", "ランダム", "福袋", "よりどり",
]
# Product lines sold by count although a measure is printed.
COUNT_FIRST_PRODUCTS = "防カビくん煙剤|お風呂カビーヌ|風呂釜クリーナー"
# Review signals collected per category.
REVIEW_SIGNALS = [
    "選べる", "サイズ選択", "ふるさと納税", "バリエーション", "アソート",
    "詰め合わせ", "詰合せ", "お試し", "各種",
]
# Offer providers in display order, with their labels.
PROVIDERS = ["rakuten", "yahoo", "amazon"]
BASE_PROVIDER = "rakuten"
UNPRICED_PROVIDER = "amazon"
PROVIDER_LABELS = {"rakuten": "楽天市場", "yahoo": "Yahoo!ショッピング", "amazon": "Amazon"}
PROVIDER_SHORT = {"rakuten": "楽天", "yahoo": "Yahoo!", "amazon": "Amazon"}
