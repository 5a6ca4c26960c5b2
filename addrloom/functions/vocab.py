"""Word lists and tables of the address domain. All are fixed values."""

from __future__ import annotations

#: Postal abbreviations of states and their names.
STATES = {
    "AL": "ALABAMA", "AK": "ALASKA", "AR": "ARKANSAS", "AZ": "ARIZONA", "CA": "CALIFORNIA", "CO": "COLORADO", "CT": "CONNECTICUT",
    "DC": "DISTRICT OF COLUMBIA", "DE": "DELAWARE", "FL": "FLORIDA", "GA": "GEORGIA", "HI": "HAWAII", "IA": "IOWA", "ID": "IDAHO",
    "IL": "ILLINOIS", "IN": "INDIANA", "KS": "KANSAS", "KY": "KENTUCKY", "LA": "LOUISIANA", "MA": "MASSACHUSETTS", "MD": "MARYLAND",
    "ME": "MAINE", "MI": "MICHIGAN", "MN": "MINNESOTA", "MO": "MISSOURI", "MS": "MISSISSIPPI", "MT": "MONTANA", "NC": "NORTH CAROLINA",
    "ND": "NORTH DAKOTA", "NE": "NEBRASKA", "NH": "NEW HAMPSHIRE", "NJ": "NEW JERSEY", "NM": "NEW MEXICO", "NV": "NEVADA",
    "NY": "NEW YORK", "OH": "OHIO", "OK": "OKLAHOMA", "OR": "OREGON", "PA": "PENNSYLVANIA", "RI": "RHODE ISLAND", "SC": "SOUTH CAROLINA",
    "SD": "SOUTH DAKOTA", "TN": "TENNESSEE", "TX": "TEXAS", "UT": "UTAH", "VA": "VIRGINIA", "VT": "VERMONT", "WA": "WASHINGTON",
    "WI": "WISCONSIN", "WV": "WEST VIRGINIA", "WY": "WYOMING",
}

DIRECTIONS = {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST"}

#: Street types that get written out, and their full words.
STREET_TYPES = {
    "ALY": "ALLEY", "AVE": "AVENUE", "BLVD": "BOULEVARD", "CIR": "CIRCLE", "CT": "COURT", "CV": "COVE", "DR": "DRIVE", "HWY": "HIGHWAY",
    "LN": "LANE", "LOOP": "LOOP", "PKWY": "PARKWAY", "PL": "PLACE", "RD": "ROAD", "SQ": "SQUARE", "ST": "STREET", "TER": "TERRACE",
    "TRL": "TRAIL", "WAY": "WAY",
}

#: Other spellings of street types, with rarer types of the postal standard.
STREET_TYPE_SPELLINGS = {
    "AV": "AVE", "AVEN": "AVE", "AVN": "AVE", "AVNUE": "AVE", "BOUL": "BLVD", "BOULV": "BLVD", "CIRC": "CIR", "CRCL": "CIR", "COURTS": "CT",
    "DRIV": "DR", "DRV": "DR", "HIGHWY": "HWY", "HIWAY": "HWY", "HIWY": "HWY", "HWAY": "HWY", "LANES": "LN", "PKWAY": "PKWY", "PKY": "PKWY",
    "PARKWY": "PKWY", "PARKWAYS": "PKWY", "ROADS": "RD", "STRT": "ST", "STR": "ST", "TERR": "TER", "TR": "TRL", "TRAILS": "TRL",
    "ANNEX": "ANX", "ARCADE": "ARC", "BEND": "BND", "BRANCH": "BR", "BRIDGE": "BRG", "BROOK": "BRK", "BYPASS": "BYP", "CAUSEWAY": "CSWY",
    "CENTER": "CTR", "COMMONS": "CMNS", "CRESCENT": "CRES", "CROSSING": "XING", "DALE": "DL", "DIVIDE": "DV", "EXPRESSWAY": "EXPY",
    "EXTENSION": "EXT", "FERRY": "FRY", "FIELD": "FLD", "FLAT": "FLT", "FORD": "FRD", "FOREST": "FRST", "FORGE": "FRG", "FORK": "FRK",
    "FREEWAY": "FWY", "GARDEN": "GDN", "GATEWAY": "GTWY", "GLEN": "GLN", "GREEN": "GRN", "GROVE": "GRV", "HARBOR": "HBR", "HAVEN": "HVN",
    "HEIGHTS": "HTS", "HILL": "HL", "HOLLOW": "HOLW", "ISLAND": "IS", "JUNCTION": "JCT", "KEY": "KY", "KNOLL": "KNL", "LANDING": "LNDG",
    "LIGHT": "LGT", "LOCK": "LCK", "LODGE": "LDG", "MALL": "MALL", "MANOR": "MNR", "MEADOW": "MDW", "MILL": "ML", "MOTORWAY": "MTWY",
    "MOUNT": "MT", "MOUNTAIN": "MTN", "ORCHARD": "ORCH", "PARK": "PARK", "PASS": "PASS", "PATH": "PATH", "PIKE": "PIKE", "PLAIN": "PLN",
    "PLAZA": "PLZ", "POINT": "PT", "PORT": "PRT", "PRAIRIE": "PR", "RADIAL": "RADL", "RAMP": "RAMP", "RANCH": "RNCH", "RAPID": "RPD",
    "REST": "RST", "RIDGE": "RDG", "RIVER": "RIV", "ROUTE": "RTE", "ROW": "ROW", "RUE": "RUE", "RUN": "RUN", "SHOAL": "SHL", "SHORE": "SHR",
    "SKYWAY": "SKWY", "SPRING": "SPG", "STATION": "STA", "STRAVENUE": "STRA", "STREAM": "STRM", "SUMMIT": "SMT", "TRACE": "TRCE",
    "TRACK": "TRAK", "TRAFFICWAY": "TRFY", "TUNNEL": "TUNL", "TURNPIKE": "TPKE", "UNDERPASS": "UPAS", "UNION": "UN", "VALLEY": "VLY",
    "VIADUCT": "VIA", "VIEW": "VW", "VILLAGE": "VLG", "VILLE": "VL", "VISTA": "VIS", "WALK": "WALK", "WELL": "WL",
}

UNIT_TYPES = {"APT": "APARTMENT", "STE": "SUITE", "UNIT": "UNIT", "FL": "FLOOR", "BLDG": "BUILDING", "RM": "ROOM"}

#: Typing errors in queries.
STATE_TYPOS = {
    "MISSIPPI": "MS", "MISSPPI": "MS", "MISSPI": "MS", "MISSISSPI": "MS", "MISSISSIPI": "MS", "MISISSIPI": "MS", "MISISIPI": "MS",
    "MISSISIPPI": "MS", "MISISIPPI": "MS", "MISISSIPPI": "MS", "MISSISSPPI": "MS",
}
STREET_TYPE_TYPOS = {
    "SR": "ST", "SY": "ST", "DT": "ST", "STRET": "ST", "STREE": "ST", "STRETT": "ST", "XR": "DR", "FR": "DR", "DN": "DR", "DRIE": "DR",
    "DRIEV": "DR", "DRIVEE": "DR", "RN": "RD", "RF": "RD", "RAOD": "RD", "RODA": "RD", "LF": "LN", "KN": "LN", "AB": "AVE", "AC": "AVE",
    "SV": "AVE", "AVNE": "AVE", "AVNEU": "AVE", "CIRCDE": "CIR", "BLD": "BLVD", "BLV": "BLVD", "BVLD": "BLVD",
}
#: Read as a street type only where a street type is expected.
CONTEXT_STREET_TYPE_TYPOS = {"SE": "ST"}
UNIT_TYPE_TYPOS = {"APPT": "APT", "APRT": "APT", "APART": "APT", "SUIT": "STE", "SUTE": "STE", "UNIIT": "UNIT", "UNITE": "UNIT", "UNT": "UNIT", "UNUT": "UNIT"}

MISSING = ("", "N/A", "NA", "NONE", "NULL", "NOT STATED", "UNKNOWN", "<NULL>")
PLACE_PLACEHOLDERS = ("COUNTY", "RURAL", "UNINC", "UNINCORPORATED", "OUTSIDE", "OTHER", "MISSISSIPPI", "MS")
KEPT_UPPER = ("US", "MS", "SR", "CR", "FM", "I", "II", "III", "IV", "MLK")
#: (state, zip, city, street, type) whose street name is known to be misspelt.
STREET_CORRECTIONS = {("MS", "39345", "NEWTON", "CLARKE", "AVE"): "Clark"}
STATE_ZIP_PREFIXES = {"MS": tuple(str(p) for p in range(386, 398))}
DESCRIPTOR_STARTS = ("ACROSS", "ADJ", "ADJACENT", "BEHIND", "BETWEEN", "NEAR", "OFF", "OF", "ON", "REAR")
DESCRIPTOR_LAND = ("LAND", "LOT", "PART", "PT")
DESCRIPTOR_WHERE = ("AT", "BEHIND", "NEAR", "OF", "ON", "SOUTH", "NORTH", "EAST", "WEST")
DESCRIPTOR_DATE = r"(?i)\bDOD\b\s*(?:\d{6,8}|\d{1,2}(?:\s*[/-]\s*|\s+)\d{1,2})"
SIDE_OF_ROAD = r"(?i)^\s*[NSEW]\s*/\s*S\.?\s+"

COUNTIES = (
    "adams", "alcorn", "amite", "attala", "benton", "bolivar", "calhoun", "carroll", "chickasaw", "choctaw", "claiborne", "clarke",
    "clay", "coahoma", "copiah", "covington", "desoto", "forrest", "franklin", "george", "greene", "grenada", "hancock", "harrison",
    "hinds", "holmes", "humphreys", "issaquena", "itawamba", "jackson", "jasper", "jefferson", "jeffersondavis", "jones", "kemper",
    "lafayette", "lamar", "lauderdale", "lawrence", "leake", "lee", "leflore", "lincoln", "lowndes", "madison", "marion", "marshall",
    "monroe", "montgomery", "neshoba", "newton", "noxubee", "oktibbeha", "panola", "pearlriver", "perry", "pike", "pontotoc",
    "prentiss", "quitman", "rankin", "scott", "sharkey", "simpson", "smith", "stone", "sunflower", "tallahatchie", "tate", "tippah",
    "tishomingo", "tunica", "union", "walthall", "warren", "washington", "wayne", "webster", "wilkinson", "winston", "yalobusha",
    "yazoo",
)
COUNTY_SPELLINGS = {"jeffdavis": "jeffersondavis", "tallawalth": "tallahatchiewalthall"}

#: How far a source's rows are trusted, by format.
SOURCE_QUALITY = {"address_record": 1.0, "maris": 0.92, "openaddresses": 0.86, "generic": 0.80, "nad": 0.76, "maris_parcels": 0.62}
COUNTY_ONLY_STATUS, COUNTY_ONLY_QUALITY, OTHER_QUALITY = "county_only_situs", 0.72, 0.50

#: Columns by role that the formats use, first found first.
FULL_ADDRESS_FIELDS = ("full_address", "fulladdr", "full_addr", "street_address", "address", "address1", "address_line_1", "line1", "addr", "situs_address", "site_address", "property_address")
CITY_FIELDS = ("city", "locality", "municipality", "post_city", "postal_city")
STATE_FIELDS = ("state", "region", "province")
ZIP_FIELDS = ("zip_code", "zipcode", "zip", "postcode", "postal_code")
POINT_CITY_FIELDS = ("COMMUNITY", "CITY", "POST_COMM", "PostComm", "POST_CITY", "MUNI", "L_COMMUNIT", "R_COMMUNIT", "Uninc_Comm", "UnincComm", "MSAGComm")
POINT_ZIP_FIELDS = ("ZCTA5CE10", "ZIP", "ZIP_CODE", "ZIPCODE", "POSTCODE", "L_ZIP", "R_ZIP")
PARCEL_CITY_FIELDS = ("SCITY", "SITUSCITY", "SITE_CITY", "CITY")
PARCEL_ZIP_FIELDS = ("SZIP", "SITUSZIP", "SITE_ZIP", "ZIP", "ZIP_CODE")
PARCEL_LINE_FIELDS = ("SITEADD", "SITUSADDR", "SITUS_ADD", "SITE_ADDR", "PROPERTY_ADDRESS")
NATIONAL_CITY_FIELDS = ("Post_City", "Inc_Muni", "Census_Plc", "Uninc_Comm")

STREET_TYPE_CONFUSIONS = {
    "ALY": ("LN", "RD"), "AVE": ("RD", "ST", "DR"), "BLVD": ("AVE", "RD"), "CIR": ("CT", "LOOP", "CV"), "CT": ("CIR", "PL"), "CV": ("CT", "CIR"),
    "DR": ("RD", "AVE", "ST", "WAY"), "HWY": ("RD", "BLVD"), "LN": ("RD", "DR", "ALY"), "LOOP": ("CIR", "TRL"), "PKWY": ("HWY", "RD", "DR"),
    "PL": ("CT", "TER"), "RD": ("DR", "ST", "AVE"), "SQ": ("PL", "CIR"), "ST": ("RD", "AVE", "DR"), "TER": ("PL", "TRL"), "TRL": ("TER", "LOOP"),
    "WAY": ("DR", "RD"),
}
STREET_TYPE_KEY_TYPOS = {
    "AVE": ("ABE", "SVE", "AVW"), "BLVD": ("BKVD", "BLBD", "BLVF"), "CIR": ("CUR", "CJR", "CIE"), "CT": ("CR", "CY", "XT"), "DR": ("FR", "SR", "DE"),
    "LN": ("KN", "LM", "LB"), "RD": ("RF", "RS", "ED"), "ST": ("SR", "SY", "DT", "SE"), "TER": ("TRR", "TWR", "TED"), "TRL": ("TRK", "TRP", "TRLN"),
}
KEY_NEIGHBOURS = {
    "a": "sqwz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "i": "ujko", "j": "huikmn",
    "k": "jiolm", "l": "kop", "m": "njk", "n": "bhjm", "o": "iklp", "p": "ol", "q": "wa", "r": "edft", "s": "awedxz", "t": "rfgy", "u": "yhji",
    "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx",
}
OCR_LETTERS = {"a": "o", "b": "8", "c": "e", "e": "c", "g": "9q", "i": "1l", "l": "1i", "m": "nn", "n": "m", "o": "0", "q": "9", "r": "n", "s": "5", "t": "1", "u": "v", "v": "u", "z": "2"}
OCR_DIGITS = {"0": "O", "1": "I", "2": "Z", "5": "S", "6": "8", "8": "B"}
SOUND_ALIKES = (("PH", "F"), ("CK", "K"), ("QU", "KW"), ("X", "KS"), ("Z", "S"), ("C", "K"), ("K", "C"), ("V", "B"), ("B", "V"), ("DG", "J"), ("TION", "SHUN"), ("GH", "G"), ("Y", "I"))


def with_codes(table: dict[str, str], **more: str) -> dict[str, str]:
    """Word or code -> code."""
    return {**{code: code for code in table}, **{word: code for code, word in table.items()}, **more}


DIRECTION_CODES = with_codes(DIRECTIONS)
STREET_TYPE_CODES = with_codes(STREET_TYPES, **STREET_TYPE_SPELLINGS)
UNIT_TYPE_CODES = with_codes(UNIT_TYPES)
STATE_CODES = with_codes(STATES)

PARTS = ("house_number", "predir", "street_name", "street_type", "suffixdir", "unit_type", "unit_value", "city", "state", "zip_code")

FEATURES = (
    "bias", "full_similarity", "street_name_similarity", "street_signature_overlap", "city_similarity", "house_similarity", "zip_exact",
    "zip_prefix", "type_exact", "type_missing", "predir_exact", "suffixdir_exact", "unit_exact", "unit_missing", "state_exact",
    "city_state_exact", "house_exact", "street_exact", "locality_corrected", "missing_city", "missing_state", "missing_zip", "rough",
    "street_phonetic_similarity", "city_phonetic_similarity", "zip_city_consistency", "house_mismatch_strong_context", "source_quality",
)
#: What the accept tree looks at: features, and the two of the ranking.
ACCEPT_INPUTS = (
    "full_similarity", "street_name_similarity", "street_signature_overlap", "city_similarity", "house_similarity", "zip_exact", "zip_prefix",
    "state_exact", "city_state_exact", "house_exact", "street_exact", "locality_corrected", "rough", "best_score", "margin",
    "street_phonetic_similarity", "city_phonetic_similarity", "zip_city_consistency", "house_mismatch_strong_context", "source_quality",
)
