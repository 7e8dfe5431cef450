"""Finders that need more than a pattern: token scans with checks of what stands around, as native expressions.

Each takes the text of a line and gives its spans (start, end, token).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import spans as S
from ..functions import validators as V

# Words around values, name lists (our own short selection), shapes of plates by country.
SEX = "男|女"
NAME_LABELS_LATIN = "Ship to|Bill to|Deliver to|Recipient|Passenger|Full name|Name|Guest|Cardholder"
NAME_LABELS_HAN = "收货人|收件人|寄件人|姓名|联系人|乘机人|乘车人"
KEY_PREFIXES = ("sk-", "ghp_", "gho_", "ghs_", "AKIA", "eyJ")
PHONE_STOP = ("电话", "手机", "联系电话", "手机号", "客服", "热线", "座机", "传真", "号码", "联系方式")
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段钱汤尹黎易常武乔贺赖龚文"
FIRST = "James Mary John Linda Robert Susan Michael Karen William Nancy David Lisa Richard Emma Joseph Alice Thomas Anna Charles Laura Daniel Sarah Paul Emily Mark Grace George Helen Kevin Julia Brian Diana Edward Claire Peter Sophie Henry Olivia".split()
LAST = "Smith Johnson Brown Jones Miller Davis Wilson Anderson Taylor Thomas Moore Martin Jackson Thompson White Harris Clark Lewis Robinson Walker Young King Wright Scott Green Baker Adams Nelson Hill Campbell Mitchell Roberts Carter Phillips Evans Turner".split()
BRANDS = ("Calvin Klein", "Ralph Lauren", "Tommy Hilfiger", "Paul Smith", "Mary Kay", "Thomas Cook", "George Foreman", "Charles Schwab", "Helen Keller")
PINYIN_SURNAMES = "Wang Li Zhang Liu Chen Yang Zhao Huang Zhou Wu Xu Sun Hu Zhu Gao Lin He Guo Ma Luo".split()
PINYIN_SYLLABLE = "(?:[BPMFDTNLGKHJQXRZCSYW]|Zh|Ch|Sh)?(?:iang|iong|uang|ang|eng|ing|ong|ian|iao|uai|uan|ai|ei|ao|ou|an|en|in|un|ia|ie|iu|ua|uo|ui|ue|a|e|i|o|u)"
ROAD = "(?:[一-鿿]{1,6}?(?:大道|大街|路|街|巷|弄|道))"
UNIT = "(?:[0-9]{1,5}(?:-[0-9]{1,4})?(?:号楼|号院|号|栋|幢|单元|室|楼|层|座))"
HINT = "(?:[一-鿿]{1,6}?(?:省|市|区|县|镇|乡|村|小区|花园|公寓|大厦|广场))"
UNIT_WORDS = "Apt|Apartment|Unit|Suite|Ste|Floor|Fl|Room|Rm|#"
STREET_WORDS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Way|Square|Sq|Terrace|Ter|Parkway|Pkwy|Highway|Hwy|Close|Crescent|Cres"
STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
PROVINCES = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼"
PLATES_CHINA = (
    rf"[{PROVINCES}][A-HJ-NP-Z][·• ]?[A-HJ-NP-Z0-9]{{5}}", rf"[{PROVINCES}][A-HJ-NP-Z][·• ]?(?:[DF][A-HJ-NP-Z0-9][0-9]{{4}}|[0-9]{{5}}[DF])",
    rf"[{PROVINCES}][A-HJ-NP-Z][·• ]?[A-HJ-NP-Z0-9]{{4}}[警学挂试超]", r"粤Z[·• ]?[A-HJ-NP-Z0-9]{4}[港澳]", r"[0-9]{6}使", rf"[{PROVINCES}][A-HJ-NP-Z][·• ]?[0-9]{{4}}领",
    r"WJ[·• ]?[0-9]{2}[·• ]?[0-9]{5}", rf"[{PROVINCES}]O[·• ]?[A-Z0-9]{{5}}",
)
PLATES_DISTINCT = {
    "jp": r"[一-鿿]{1,4} ?[0-9]{2,3} ?[ぁ-ん] ?[0-9]{2}-[0-9]{2}", "in": r"[A-Z]{2}[ -]?[0-9]{2}[ -]?[A-Z]{1,2}[ -]?[0-9]{4}", "in_bh": r"[0-9]{2} ?BH ?[0-9]{4} ?[A-Z]{1,2}",
    "uk": r"[A-Z]{2}[0-9]{2} [A-Z]{3}", "fr_it": r"[A-Z]{2}-[0-9]{3}-[A-Z]{2}", "br": r"[A-Z]{3}[0-9][A-Z][0-9]{2}", "ru": r"[АВЕКМНОРСТУХ][0-9]{3}[АВЕКМНОРСТУХ]{2} ?[0-9]{2,3}",
    "ua_bg": r"[А-Я]{2} ?[0-9]{4} ?[А-Я]{2}", "sg": r"S[A-Z]{2} ?[0-9]{1,4} ?[A-Z]", "be": r"[0-9]-[A-Z]{3}-[0-9]{3}", "nl": r"[A-Z]{2}-[0-9]{3}-[A-Z]", "ie": r"[0-9]{2,3}-[A-Z]{1,2}-[0-9]{1,6}", "vn": r"[0-9]{2}[A-Z]-[0-9]{3}\.[0-9]{2}",
}
PLATES_ALONE = {
    "de": r"[A-ZÄÖÜ]{1,3}[- ][A-Z]{1,2} ?[0-9]{1,4}[EH]?", "es": r"[0-9]{4} [BCDFGHJKLMNPRSTVWXYZ]{3}", "abc_1234": r"[A-Z]{3}[- ][0-9]{3,4}", "ca": r"[0-9][A-Z]{3}[0-9]{3}", "id": r"[A-Z]{1,2} [0-9]{1,4} [A-Z]{1,3}",
    "pl_no_dk": r"[A-Z]{2} ?[0-9]{5}", "cz": r"[0-9][A-Z][0-9A-Z] [0-9]{4}", "tr": r"[0-9]{2} [A-Z]{1,3} [0-9]{2,4}", "ru_short": r"[АВЕКМНОРСТУХ][0-9]{3}[АВЕКМНОРСТУХ]{2}", "pt_nl_mo": r"[A-Z0-9]{2}-[A-Z0-9]{2}-[A-Z0-9]{2}",
}
#: Words for numbers of other things: a Latin shape in a line with one of them is no plate by its shape alone.
CODE_CONTEXT = r"(?i)(?<![A-Za-z])(?:orders?|invoice|receipt|model|part|item|flight|ref|reference|code|sku|serial|version|room|gate|seat|tracking)(?![A-Za-z])|订单|型号|航班|编号|单号|货号|序列号"
#: Words that stand where names stand in labels and headers but are none.
NOT_NAMES = (
    "Account Address All Amount And Any Area Auto Balance Bank Best Billing Bonus Book Branch Business Card Cash Center Centre Charge Check City Class Club Code Company Confirm Contact Cost Country Credit Customer Data Date Daily Deal "
    "Delivery Department Deposit Desk Detail Details Discount Dollar Due Email Entry Event Express Fee File First Flight For Form Free Friend From Gate General Gift Group Guest Help Here Home Hotel Hour House Internet Invoice Item "
    "Last Lounge Mail Mailing May Member Menu Mobile Mode Monthly More Name Network New Next Not Note Notice Number Offer Office Online Only Open Order Our Page Parcel Park Parking Pass Password Payment Pending Phone Please Point "
    "Points Policy Price Private Product Public Receipt Required Room Sale Search Section See Select Service Services Shipping Shop Sign Standard Start Status Store Street Subtotal Support Tax Team Terms Text Thank Thanks The Ticket "
    "Time To Today Total Transfer Type Unknown Update User View Visit Voucher Waiting Website Weekly Welcome Whom Wi Wifi With Work Your Zone"
).split()


def _any(*patterns: str) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def _words(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def cards(text: Column, most: int = 8) -> Column:
    """Groups of digits, one blank or hyphen apart, that make 13 to 19 digits with a right check digit; from the left, the longest
    of `most` groups."""

    def from_groups(g):
        def of(x, i):
            def upto(k):
                end = F.get(g, i + k)["end"]
                return F.struct(x["start"].alias("start"), end.alias("end"), F.substring(text, x["start"] + 1, end - x["start"]).alias("token"))

            return F.transform(F.sequence(F.lit(most - 1), F.lit(0), F.lit(-1)), upto)

        def fits(c):
            digits = V.digits_of(c["token"])
            return c["end"].isNotNull() & (F.length(c["token"]) <= 37) & F.length(digits).between(13, 19) & c["token"].rlike("^[0-9]+(?:[ -][0-9]+)*$") & (S.before(text, c["start"], 1) != "-") & (S.after(text, c["end"], 1) != "-") & V.luhn(digits)

        return S.first_come(F.filter(F.flatten(F.transform(g, of)), fits), "struct<start:int,end:int,token:string>")

    enough = F.length(V.digits_of(text)) >= 13
    return F.when(enough, S.let(S.find_spans(text, "[0-9]+"), from_groups)).otherwise(S.none())


def ibans(text: Column) -> Column:
    """From a country code and check digits on, as many characters as the country has, blanks aside; its check must be right."""
    lengths = F.create_map(*[F.lit(x) for pair in V.IBAN_LENGTHS.items() for x in pair])
    starts = S.find_spans(text, r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")

    def whole(x):
        n = F.try_element_at(lengths, F.left(x["token"], F.lit(2)))
        pattern = F.concat(F.lit("^((?:[A-Z0-9] ?){"), (n - 1).cast("string"), F.lit("}[A-Z0-9])(?![A-Z0-9])"))
        value = F.when(n.isNotNull(), F.call_function("regexp_extract", F.substring(text, x["start"] + 1, F.lit(60)), pattern, F.lit(1))).otherwise("")
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(value)).alias("end"), value.alias("token"))

    return F.filter(F.transform(starts, whole), lambda x: V.iban(x["token"]))


def masked_mobiles(text: Column) -> Column:
    """A mobile number of eleven places of which three or more are masked: digits, masks and blanks around them."""
    runs = S.find_spans(text, r"(?<![0-9A-Za-z])\+?[0-9](?:[ -]?[0-9*＊•●xX]){7,15}(?![0-9A-Za-z])")

    def fits(x):
        places = F.regexp_replace(F.regexp_replace(x["token"], "[ +-]", ""), "^86(?=1[3-9])", "")
        masks = F.length(F.regexp_replace(places, "[0-9]", ""))
        return places.startswith("1") & F.length(places).between(10, 12) & (masks >= 3) & (F.regexp_count(places, F.lit("[^0-9]+")) == 1)

    return F.filter(runs, fits)


def vins(text: Column) -> Column:
    """Words of seventeen capitals and digits with a right check digit; O, Q and I count as the digits they look like."""
    words = S.find_spans(text, "(?<![A-Za-z0-9])(?:VIN)?[A-Z0-9]{17}(?![A-Za-z0-9])")

    def last(x):
        return F.struct((x["end"] - 17).alias("start"), x["end"].alias("end"), F.right(x["token"], F.lit(17)).alias("token"))

    def fits(x):
        year = F.substring(x["token"], 10, 1)
        ends = F.right(x["token"], F.lit(4)).rlike("^[0-9]{4}$") & ~year.isin("0", "U", "Z")
        return V.vin(F.translate(x["token"], "OQI", "001")) & F.substring(x["token"], 4, 14).rlike("[A-Z]") & ends

    return F.filter(F.transform(words, last), fits)


def valued(labels: str, value: str, between: str = r"\s{0,2}[:：]?\s{0,2}", check=None):
    """Values right behind one of the labels."""

    def find(text: Column) -> Column:
        found = S.find_spans(text, value)
        ok = F.filter(found, lambda x: S.before(text, x["start"], 30).rlike(rf"(?:{labels}){between}$"))
        return F.filter(ok, lambda x: check(x["token"])) if check else ok

    return find


def collect_codes(text: Column) -> Column:
    """A code of four digits or more behind 凭, where the rest of the sentence tells to fetch something."""
    words = S.find_spans(text, "[A-Za-z0-9]++(?: ?[-－] ?[A-Za-z0-9]++){0,6}")

    def fits(x):
        rest = F.regexp_extract(F.substring(text, x["end"] + 1, F.lit(200)), "^[^。；;！!？?]*", 0)
        return (F.regexp_count(x["token"], F.lit("[0-9]")) >= 4) & S.before(text, x["start"], 2).rlike("凭 ?$") & rest.rlike("取(?!消)|领|提货")

    return F.filter(words, fits)


def names_before_phones(text: Column) -> Column:
    """Two to four Chinese characters that begin with a surname and end three separators at most before a mobile number."""
    # A matcher asks a class of many characters for one after the other: first whether the place is Chinese at all.
    pattern = rf"(?=[一-鿿])(?<![一-鿿])[{SURNAMES}][一-鿿]{{1,3}}(?=[ ,，:：;；/|]{{0,3}}(?:\+?86[ -]?)?1[3-9][0-9])"
    return F.filter(S.find_spans(text, pattern), lambda x: ~x["token"].isin(*PHONE_STOP))


def diploma_names(text: Column) -> Column:
    """The name in 'student X, sex' and in 'X, sex, born'."""
    student = rf"(?<=学生|學生)[ :：]?[一-鿿]{{2,4}}(?=[ ,，、]{{1,2}}(?:性别)?[ :：]?(?:{SEX}))"
    born = rf"(?<![一-鿿])[一-鿿]{{2,4}}(?=[,，、] ?(?:{SEX})[,，、] ?[^。]{{0,20}}(?:出生|生))"
    found = F.array_sort(F.concat(S.find_spans(text, student), S.find_spans(text, born)))

    def trim(x):
        value = F.regexp_replace(x["token"], "^[ :：]", "")
        return F.struct((x["end"] - F.length(value)).alias("start"), x["end"].alias("end"), value.alias("token"))

    return F.when(text.rlike(f"[{SEX.replace('|', '')}]"), F.transform(found, trim)).otherwise(S.none())


def name_cues(text: Column) -> Column:
    """Names behind a greeting, a title, a role or a mail header, in front of an address in angle brackets, after a tilde, in
    the order of airlines, and in system messages."""
    one, more = r"[A-Z][a-z'’-]+", r"[A-Z][a-z'’-]+(?: [A-Z]\.)?(?: [A-Z][a-z'’-]+){0,2}"
    cues = _any(
        rf"(?<=^Hi |^Hey |^Hello |^Dear ){more}(?=[,!.]|$)",
        rf"(?<=\bMr\.? |\bMrs\.? |\bMs\.? |\bDr\.? |\bProf\.? |\bMiss ){more}",
        rf"(?<=\bDriver: |\bCourier: |\bSeller: |\bAgent: |\bHost: |\bDoctor: |\bTeacher: ){more}",
        rf"(?<=^From: |^To: |^Cc: ){one}(?: {one}){{1,2}}",
        rf"(?<![A-Za-z]){one}(?: {one}){{1,2}}(?= <[^ >]+@)",
        rf"(?<=[~～] ?){one}(?: {one})?",
        r"(?<![A-Za-z/])[A-Z]{2,}/[A-Z]{2,}(?= (?:MR|MRS|MS|MISS|MSTR)\b)",
        rf"(?<![A-Za-z]){one}(?: {one})?(?= (?:joined|left|was added|was removed)\b)",
    )
    return F.filter(S.find_spans(text, f"(?=[A-Z])(?:{cues})"), lambda x: no_other_words(x["token"]) & ~x["token"].isin("Mr", "Mrs", "Ms", "Dr", "Prof", "Miss", "Sir", "Madam", "Customer", "Team", "All", "There", "Everyone", "Customer Reviews", "Guest"))


def no_other_words(token: Column) -> Column:
    """Whether none of the token's words is one that only looks like a name."""
    return ~token.rlike(rf"(?<![A-Za-z])(?:{'|'.join(NOT_NAMES)})(?![A-Za-z])")


def labelled_names(text: Column) -> Column:
    """A name behind a label: Latin labels need a colon, Chinese ones a colon or a blank."""
    latin = r"[A-Z][a-z'-]+(?: [A-Z][a-z'.-]*){1,3}(?![A-Za-z])"
    found = S.find_spans(text, rf"{latin}|(?<![一-鿿])[一-鿿]{{2,4}}(?![一-鿿])|(?<=[:：])[一-鿿]{{2,4}}(?![一-鿿])")

    def fits(x):
        lead = S.before(text, x["start"], 24)
        english = lead.rlike(rf"(?<![A-Za-z])(?:{NAME_LABELS_LATIN})\s{{0,2}}[:：]\s{{0,2}}$|(?:{NAME_LABELS_HAN})\s{{0,2}}[:：]\s{{0,2}}$")
        chinese = x["token"].rlike("^[一-鿿]") & lead.rlike(rf"(?:^|[^一-鿿])(?:{NAME_LABELS_HAN})\s{{1,2}}$")
        return (english | chinese) & no_other_words(x["token"]) & ~x["token"].isin(*PHONE_STOP)

    return F.when(text.rlike(S.by_first(f"{NAME_LABELS_LATIN}|{NAME_LABELS_HAN}")), F.filter(found, fits)).otherwise(S.none())


def emails(text: Column, known=V.known_tld) -> Column:
    """Runs of the characters of addresses, marks at their end aside, with one @ between a name and a host of known suffix."""

    def trimmed(x):
        value = F.rtrim(x["token"], F.lit(".-"))
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(value)).alias("end"), value.alias("token"))

    def fits(x):
        sides = F.split(x["token"], "@")
        labels = F.split(F.get(sides, F.lit(1)), r"\.")
        whole = F.forall(labels, lambda y: y.rlike("^[A-Za-z0-9-]+$")) & F.element_at(labels, -1).rlike("^[A-Za-z]{2,24}$")
        return (F.size(sides) == 2) & (F.get(sides, F.lit(0)) != "") & (F.size(labels) >= 2) & whole & known(F.element_at(labels, -1))

    return F.filter(F.transform(S.find_spans(text, "(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]*+@[A-Za-z0-9._%+@-]*+"), trimmed), fits)


def common_emails(text: Column) -> Column:
    """Addresses whose hosts end in a country or in com, org or net, written small."""
    return emails(text, lambda x: (F.length(x) == 2) | x.isin("com", "org", "net"))


def social_numbers(text: Column) -> Column:
    """Groups of three, two and four digits a hyphen apart that can be a social security number."""
    return F.filter(S.find_spans(text, "[0-9]+(?:-[0-9]+)*"), lambda x: (S.after(text, x["end"], 1) != "-") & (S.before(text, x["start"], 1) != "-") & V.ssn(x["token"]))


def hardware_addresses(text: Column) -> Column:
    """Runs of hexadecimal digits with colons or hyphens that are six pairs with one kind of mark."""
    return F.filter(S.find_spans(text, "[0-9A-Fa-f:-]{11,}"), lambda x: V.mac(x["token"]))


def api_keys(text: Column) -> Column:
    """Words that begin as keys of services do and go on for twelve characters or more, with over 3.5 bits a character."""
    words = S.find_spans(text, "[A-Za-z0-9_.-]+")

    def fits(x):
        begins = F.lit(False)
        for prefix in KEY_PREFIXES:
            begins = begins | (x["token"].startswith(prefix) & (F.length(x["token"]) >= len(prefix) + 12))
        return begins & (V.entropy(x["token"]) > 3.5)

    return F.filter(words, fits)


def times(text: Column) -> Column:
    """Hours and minutes, perhaps seconds and half of the day."""
    found = S.find_spans(text, r"[0-9]{1,2}(?::[0-9]{2})+(?: ?[AaPp]\.?[Mm]\b\.?)?")

    def fits(x):
        part = F.split(F.regexp_extract(x["token"], "^[0-9:]+", 0), ":")
        below = lambda i, n: F.coalesce(F.get(part, F.lit(i)).cast("int") < n, F.lit(True))
        return F.size(part).between(2, 3) & below(0, 24) & below(1, 60) & below(2, 60) & ~S.before(text, x["start"], 1).rlike("[0-9:.]") & ~S.after(text, x["end"], 1).rlike("[0-9:]")

    return F.filter(found, fits)


def dates_and_times(text: Column) -> Column:
    """Dates with the time behind them, month and day with a time, and times alone; a date must be in the calendar."""
    days = F.filter(S.find_spans(text, r"[0-9]{1,2}[-/][0-9]{1,2}(?= ?[0-9]{1,2}:)"), lambda x: F.substring_index(F.replace(x["token"], F.lit("/"), F.lit("-")), "-", 1).cast("int").between(1, 12) & F.regexp_extract(x["token"], "[0-9]+$", 0).cast("int").between(1, 31) & ~S.before(text, x["start"], 1).rlike("[0-9/.-]"))
    return S.joined_close(F.concat(D.find(text), days, times(text)), text, " ,T", 2)


def long_numbers(text: Column) -> Column:
    """Words of digits, capitals and hyphens with eight digits or more that are no date and no card number."""
    words = S.find_spans(text, "[A-Za-z0-9_－-]+")

    def bare(x):
        lead = F.length(x["token"]) - F.length(F.ltrim(x["token"], F.lit("-－")))
        value = F.trim(x["token"], F.lit("-－"))
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.length(value)).alias("end"), value.alias("token"))

    def long(dated):
        def fits(x):
            digits = V.digits_of(x["token"])
            whole = F.length(x["token"]) == F.length(F.regexp_replace(x["token"], "[^0-9A-Z－-]", ""))
            return whole & (F.length(digits) >= 8) & ~F.exists(dated, lambda d: (d["start"] <= x["start"]) & (x["end"] <= d["end"])) & ~(x["token"].rlike("^[0-9-]+$") & V.luhn(digits))

        return F.filter(F.transform(words, bare), fits)

    return S.let(dates_and_times(text), long)


def landlines(text: Column) -> Column:
    """Chinese numbers with an area code, and numbers of seven to fifteen digits behind a word for telephones."""
    found = S.find_spans(text, r"(?<![0-9A-Za-z+.-])\(?0[0-9]{1,3}\)?(?:[ -]?[0-9]){7,9}(?![0-9A-Za-z-])|(?<![0-9A-Za-z+.-])[0-9(](?:[ ().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z-])")

    def fits(x):
        digits = V.digits_of(x["token"])
        area = x["token"].rlike("^\\(?0(?:10|2[0-9]|[3-9][0-9]{2})\\)?[ -]?[2-9][0-9]{6,7}$") & F.length(digits).between(10, 12)
        led = F.lower(S.before(text, x["start"], 14)).rlike("(?:^|[^a-z])(?:tel|tel no|telephone|phone|phone no|mobile|fax|call|hotline)[.:：]? ?$|(?:电话|手机|热线|传真|客服)[:： ]{0,2}$")
        return (area | led & F.length(digits).between(7, 15)) & ~digits.rlike("^(.)\\1+$")

    return F.filter(found, fits)


def name_pairs(text: Column) -> Column:
    """A listed first name before a listed last one, or a romanised Chinese surname with one or two syllables; no brands."""
    listed = rf"(?:{_words(FIRST)})(?: [A-Z]\.)? (?:{_words(LAST)})"
    pinyin = rf"(?:{_words(PINYIN_SURNAMES)}) {PINYIN_SYLLABLE}(?:{PINYIN_SYLLABLE.lower()})?"
    found = S.find_spans(text, rf"(?=[A-Z])(?<![A-Za-z])(?:{listed}|{pinyin})(?![A-Za-z])")
    return F.filter(found, lambda x: ~x["token"].isin(*BRANDS))


def english_addresses(text: Column) -> Column:
    """Streets, units, towns with state and code, British and Canadian codes and boxes; those a comma apart are one."""
    parts = _any(
        rf"(?<![A-Za-z0-9])[0-9]{{1,6}}[A-Za-z]? (?:[NSEW]\.? )?(?:(?:[A-Z][A-Za-z'-]+|[0-9]{{1,3}}(?:st|nd|rd|th)) ){{1,4}}(?:{STREET_WORDS})\b\.?",
        rf"(?<![A-Za-z])(?:{UNIT_WORDS})\.? ?[0-9][0-9A-Za-z-]{{0,5}}(?![A-Za-z0-9])",
        rf"(?<![A-Za-z])[A-Z][A-Za-z.'-]+(?: [A-Z][A-Za-z.'-]+){{0,2}}, (?:{'|'.join(STATES)}) [0-9]{{5}}(?:-[0-9]{{4}})?(?![0-9])",
        r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][ABD-HJLNP-UW-Z]{2}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])[ABCEGHJ-NPRSTVXY][0-9][A-Z] [0-9][A-Z][0-9](?![A-Za-z0-9])",
        r"(?<![A-Za-z])(?:P\. ?O\. ?|PO |P\.O\. )[Bb][Oo][Xx] [0-9]{1,6}(?![0-9])",
    )
    joined = S.joined_close(S.find_spans(text, parts), text, ", ", 2)
    # A unit alone is no address.
    return F.filter(joined, lambda x: ~x["token"].rlike(rf"^(?:{UNIT_WORDS})\.? ?[0-9A-Za-z-]+$"))


def chinese_addresses(text: Column) -> Column:
    """Roads, house numbers and places that stand close together: a road among them, or two pieces with a number."""
    found = S.find_spans(text, _any(HINT, ROAD, UNIT))
    joined = S.joined_close(found, text, "一-鿿0-9 、-", 4)
    return F.when(text.rlike("[一-鿿]"), F.filter(joined, lambda x: (x["token"].rlike(ROAD) | x["token"].rlike(UNIT) & x["token"].rlike(HINT)) & (F.length(x["token"]) >= 5))).otherwise(S.none())


def has_address_words(text: Column) -> Column:
    """Whether text, its dates aside, has a piece of an address."""
    return F.regexp_replace(text, D.SHAPE, "").rlike(_any(ROAD, UNIT, HINT))


def plates(text: Column) -> Column:
    """Plates that their shape tells, not behind words for orders, models and the like; a Singaporean one has its check letter."""
    shapes = _any(*PLATES_CHINA, *PLATES_DISTINCT.values())
    found = S.find_spans(text, rf"(?<![A-Za-z0-9А-Яа-я-])(?:{shapes})(?![A-Za-z0-9А-Яа-я-])")

    def fits(x):
        t = x["token"]
        singapore = t.rlike(rf"^{PLATES_DISTINCT['sg']}$")
        latin = ~t.rlike("[一-鿿ぁ-んА-Яа-я]")
        return t.rlike("[0-9]") & ~(latin & text.rlike(CODE_CONTEXT)) & (~singapore | V.sg_plate(F.replace(t, F.lit(" "), F.lit(""))))

    return F.filter(found, fits)


def labelled_plates(text: Column) -> Column:
    """A plate of any shape behind a label."""
    shapes = _any(*PLATES_CHINA, *PLATES_DISTINCT.values(), *PLATES_ALONE.values(), r"[A-Z0-9]{2,4}[- ]?[A-Z0-9]{2,5}")
    found = S.find_spans(text, rf"(?<![A-Za-z0-9])(?:{shapes})(?![A-Za-z0-9])")
    label = r"(?i)(?:车牌号码?|车牌|号牌号码|牌照|license plate|licence plate|plate(?: no\.?| number)?|registration(?: no\.?)?|reg\.? no\.?)\s{0,2}[:：#]?\s{0,2}$"
    return F.filter(found, lambda x: x["token"].rlike("[0-9]") & S.before(text, x["start"], 30).rlike(label))


def alone_plate(text: Column) -> Column:
    """The whole line is a plate of a shape that is only safe on its own."""
    whole = F.trim(text)
    ok = whole.rlike(rf"^(?:{_any(*PLATES_ALONE.values())})$") & whole.rlike("[0-9]")
    start = F.instr(text, whole) - 1
    return F.when(ok, F.array(F.struct(start.cast("int").alias("start"), (start + F.length(whole)).cast("int").alias("end"), whole.alias("token")))).otherwise(S.none())


def resident_ids(text: Column) -> Column:
    """Eighteen places with a right check digit and a real birth date, also in groups one blank apart; O and x-like marks aside."""
    runs = S.find_spans(text, "(?<![0-9A-Za-z])[1-8][0-9](?: ?[0-9]){15} ?[0-9XxΧХ×](?![0-9A-Za-z])")

    def fits(x):
        t = F.translate(F.replace(x["token"], F.lit(" "), F.lit("")), "xΧХ×", "XXXX")
        y, m, d = (F.substring(t, a, n).try_cast("int") for a, n in ((7, 4), (11, 2), (13, 2)))
        return V.cn_id(t) & D.is_real(y, m, d) & (y >= 1880)

    return F.filter(runs, fits)


def checked(pattern: str, check, cue: str | None = None):
    """Matches of pattern that pass check; with a cue, only in lines that have it."""

    def find(text: Column) -> Column:
        found = F.filter(S.find_spans(text, pattern), lambda x: check(x["token"]))
        return F.when(text.rlike(cue), found).otherwise(S.none()) if cue else found

    return find
