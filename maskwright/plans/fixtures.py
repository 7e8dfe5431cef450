"""Lines with what the rules must find in them: invented values and public sample numbers. (text, kind, token); no kind: nothing."""

MRZ3 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
MRZ3B = "L898902C36UTO7408122F1204159ZE184226B<<<<<10"

RULE_LINES: tuple[tuple[str, str | None, str | None], ...] = (
    ("pay with 4111 1111 1111 1111 now", "PAYMENT_CARD", "4111 1111 1111 1111"),
    ("card 5500-0055-5555-5559", "PAYMENT_CARD", "5500-0055-5555-5559"),
    ("amex 378282246310005.", "PAYMENT_CARD", "378282246310005"),
    ("number 4111111111111112", None, None),
    ("CVV: 123", "PAYMENT_CARD", "123"),
    ("安全码 4321", "PAYMENT_CARD", "4321"),
    ("Expires 09/27", None, None),
    ("to DE89 3704 0044 0532 0130 00 please", "IBAN", "DE89 3704 0044 0532 0130 00"),
    ("GB82WEST12345698765432", "IBAN", "GB82WEST12345698765432"),
    ("to DE88370400440532013000", None, None),
    ("SSN 123-45-6789", "SSN", "123-45-6789"),
    ("see 666-45-6789", None, None),
    ("mac 00:1B:44:11:3A:B7", "MAC_ADDR", "00:1B:44:11:3A:B7"),
    ("mac 00:1B-44:11:3A:B7", None, None),
    ("mail a.b+tag@sub.example.co.uk", "EMAIL", "a.b+tag@sub.example.co.uk"),
    ("mail me@host.unknowntld", None, None),
    ("call +1 415 555 2671", "PHONE", "+1 415 555 2671"),
    ("手机 186****3392", "PHONE", "186****3392"),
    ("号码 13800138000 找我", "PHONE", "13800138000"),
    ("order 13800138000", None, None),
    (MRZ3, "PASSPORT", MRZ3),
    (MRZ3B, "PASSPORT", MRZ3B),
    ("Passport No: E12345678", "PASSPORT", "E12345678"),
    ("号 11010519491231002X 的", "ID_NUMBER", "11010519491231002X"),
    ("号 110105194912310021", None, None),
    ("id A123456(3)", "ID_NUMBER", "A123456(3)"),
    ("id A123456(4)", None, None),
    ("身分證 A123456789", "ID_NUMBER", "A123456789"),
    ("身分證 A123456788", None, None),
    ("nric S1234567D", "ID_NUMBER", "S1234567D"),
    ("nric S1234568D", None, None),
    ("cpf 529.982.247-25", "ID_NUMBER", "529.982.247-25"),
    ("cpf 111.111.111-11", None, None),
    ("MyKad 900101-14-5678", "ID_NUMBER", "900101-14-5678"),
    ("在留カード AB12345678CD", "ID_NUMBER", "AB12345678CD"),
    ("vin 1M8GDM9AXKP042788", "VIN", "1M8GDM9AXKP042788"),
    ("see 1HGCM82633A004351", None, None),
    ("key ghp_a8Zk3LqP0sXv7Tn2Wb5Y", "API_KEY", "ghp_a8Zk3LqP0sXv7Tn2Wb5Y"),
    ("key ghp_aaaaaaaaaaaaaaaaaaaa", None, None),
    ("Ship to: Mary Jones", "PERSON_NAME", "Mary Jones"),
    ("Hi Mary,", "PERSON_NAME", "Mary"),
    ("Dear Mr. Walker", "PERSON_NAME", "Walker"),
    ("Driver: Omar Haddad", "PERSON_NAME", "Omar Haddad"),
    ("From: Vera Lindqvist", "PERSON_NAME", "Vera Lindqvist"),
    ("seat HADDAD/OMAR MR", "PERSON_NAME", "HADDAD/OMAR"),
    ("route SFO/LAX", None, None),
    ("Vera Lindqvist joined", "PERSON_NAME", "Vera Lindqvist"),
    ("talked to Emma Clark today", "PERSON_NAME", "Emma Clark"),
    ("a Paul Smith jacket", None, None),
    ("met Zhang Wei there", "PERSON_NAME", "Zhang Wei"),
    ("Customer Reviews", None, None),
    ("Guest Wi-Fi", None, None),
    ("收件人：王小明", "PERSON_NAME", "王小明"),
    ("学生王小明，男", "PERSON_NAME", "王小明"),
    ("at 221 Baker Street, Unit 5, Boston, MA 02110", "POSTAL_ADDRESS", "221 Baker Street, Unit 5, Boston, MA 02110"),
    ("to P.O. Box 1234", "POSTAL_ADDRESS", "P.O. Box 1234"),
    ("London SW1A 2AA", "POSTAL_ADDRESS", "SW1A 2AA"),
    ("Ottawa K1A 0B1", "POSTAL_ADDRESS", "K1A 0B1"),
    ("北京市朝阳区建国路88号", "POSTAL_ADDRESS", "北京市朝阳区建国路88号"),
    ("5 min walk", None, None),
    ("2 ways to pay", None, None),
    ("取件码 3-2-1045", "PICKUP_CODE", "3-2-1045"),
    ("请凭 8-3-2021 到店领取", "PICKUP_CODE", "8-3-2021"),
    ("请凭 8-3-2021 入场", None, None),
    ("DOB: 1990-02-28", "BIRTH_DATE", "1990-02-28"),
    ("Born: 1990-02-31", None, None),
    ("1985年3月2日出生", "BIRTH_DATE", "1985年3月2日"),
    ("昭和60年1月2日生", "BIRTH_DATE", "昭和60年1月2日"),
    ("车 京A12345 到", "LICENSE_PLATE", "京A12345"),
    ("新 沪AD12345 车", "LICENSE_PLATE", "沪AD12345"),
    ("教练 京A1234学", "LICENSE_PLATE", "京A1234学"),
    ("plate AB12 CDE", "LICENSE_PLATE", "AB12 CDE"),
    ("model AB12 CDE", None, None),
    ("car AA-123-BB", "LICENSE_PLATE", "AA-123-BB"),
    ("car ABC1D23", "LICENSE_PLATE", "ABC1D23"),
    ("car А123ВС 77", "LICENSE_PLATE", "А123ВС 77"),
    ("car 51F-123.45", "LICENSE_PLATE", "51F-123.45"),
    ("Plate: 7ABC123", "LICENSE_PLATE", "7ABC123"),
    ("https://host.com/r/Abc", "URL", "/r/Abc"),
    ("host.com", None, None),
    ("from 192.168.1.10 on", "IP_ADDR", "192.168.1.10"),
    ("from 999.1.1.1 on", None, None),
    ("v1.2.3.4", None, None),
    ("parcel 98765432101", "LONG_NUMBER", "98765432101"),
    ("on 2024-05-06 12:30", "DATETIME", "2024-05-06 12:30"),
)

#: (family, value, valid): public sample numbers.
CHECKSUMS: tuple[tuple[str, str, bool], ...] = (
    ("luhn", "4111111111111111", True), ("luhn", "5500005555555559", True), ("luhn", "378282246310005", True), ("luhn", "4111111111111112", False), ("luhn", "0000000000000000", False),
    ("iban", "DE89370400440532013000", True), ("iban", "GB82WEST12345698765432", True), ("iban", "DE88370400440532013000", False),
    ("ssn", "123-45-6789", True), ("ssn", "666-45-6789", False), ("ssn", "123-00-6789", False),
    ("cn_id", "11010519491231002X", True), ("cn_id", "110105194912310021", False), ("hkid", "A123456(3)", True), ("hkid", "A123456(4)", False),
    ("tw_id", "A123456789", True), ("tw_id", "A123456788", False), ("nric", "S1234567D", True), ("nric", "S1234568D", False),
    ("rrn", "800101-1234560", True), ("rrn", "800101-1234561", False), ("cpf", "529.982.247-25", True), ("cpf", "111.111.111-11", False),
    ("vin", "1M8GDM9AXKP042788", True), ("vin", "1HGCM82633A004352", True), ("vin", "LFWADRJF011002347", False),
    ("mac", "00:1B:44:11:3A:B7", True), ("mac", "00:1B-44:11:3A:B7", False), ("tld", "com", True), ("tld", "zz", True), ("tld", "nosuchtld", False),
    ("ipv4", "192.168.1.10", True), ("ipv4", "192.168.01.10", False), ("ipv4", "999.1.1.1", False), ("sg_plate", "SBA1234G", True), ("sg_plate", "SBA1234H", False),
)
