"""Sectors, industries, related symbols, and the company-name dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sector ids, their names and other spellings.
SECTORS = {
    0: ("Information Technology", ["Technology", "Tech"]),
    1: ("Health Care", ["Healthcare"]),
    2: ("Financials", ["Financial Services", "Finance"]),
    3: ("Consumer Discretionary", ["Consumer Cyclical"]),
    4: ("Consumer Staples", ["Consumer Defensive"]),
    5: ("Industrials", ["Industrial"]),
    6: ("Energy", []),
    7: ("Utilities", ["Utility"]),
    8: ("Real Estate", ["REIT"]),
    9: ("Materials", ["Basic Materials"]),
    10: ("Communication Services", ["Telecommunications", "Media"]),
}

# The history layer's own sector spellings (case-sensitive).
HISTORY_SECTORS = {
    "Technology": 0,
    "Information Technology": 0,
    "Healthcare": 1,
    "Health Care": 1,
    "Financials": 2,
    "Financial Services": 2,
    "Consumer Cyclical": 3,
    "Consumer Discretionary": 3,
    "Consumer Defensive": 4,
    "Consumer Staples": 4,
    "Industrials": 5,
    "Energy": 6,
    "Utilities": 7,
    "Real Estate": 8,
    "Basic Materials": 9,
    "Materials": 9,
    "Communication Services": 10,
    "Telecommunications": 10,
}

# Industries by sector, in id order (0..68).
INDUSTRIES_BY_SECTOR = {
    0: [
        "Software",
        "Hardware",
        "Semiconductors",
        "IT Services",
        "Electronic Equipment",
        "Technology Distributors",
    ],
    1: [
        "Biotechnology",
        "Pharmaceuticals",
        "Health Care Equipment",
        "Health Care Services",
        "Life Sciences Tools",
        "Health Care Technology",
    ],
    2: [
        "Banks",
        "Insurance",
        "Capital Markets",
        "Consumer Finance",
        "Mortgage Finance",
        "Financial Exchanges",
    ],
    3: [
        "Automobiles",
        "Auto Components",
        "Household Durables",
        "Leisure Products",
        "Textiles & Apparel",
        "Hotels & Restaurants",
        "Retail - Discretionary",
        "Internet Retail",
    ],
    4: [
        "Food & Beverage",
        "Tobacco",
        "Household Products",
        "Personal Products",
        "Retail - Staples",
    ],
    5: [
        "Aerospace & Defense",
        "Building Products",
        "Construction & Engineering",
        "Electrical Equipment",
        "Industrial Conglomerates",
        "Machinery",
        "Commercial Services",
        "Professional Services",
        "Airlines",
        "Freight & Logistics",
        "Transportation Infrastructure",
    ],
    6: [
        "Oil & Gas - Exploration",
        "Oil & Gas - Integrated",
        "Oil & Gas - Refining",
        "Oil & Gas - Equipment",
        "Renewable Energy",
    ],
    7: [
        "Electric Utilities",
        "Gas Utilities",
        "Multi-Utilities",
        "Water Utilities",
        "Independent Power",
    ],
    8: [
        "Equity REITs",
        "Mortgage REITs",
        "Real Estate Services",
        "Real Estate Development",
    ],
    9: [
        "Chemicals",
        "Construction Materials",
        "Containers & Packaging",
        "Metals & Mining",
        "Paper & Forest Products",
    ],
    10: [
        "Diversified Telecom",
        "Wireless Telecom",
        "Media",
        "Entertainment",
        "Interactive Media",
        "Advertising",
        "Publishing",
        "Cable & Satellite",
    ],
}

INDUSTRIES = [(name, sector) for sector, names in INDUSTRIES_BY_SECTOR.items() for name in names]

# Vendor industry spellings -> industry id.
INDUSTRY_ALIASES = {
    "software—infrastructure": 0,
    "software—application": 0,
    "software - infrastructure": 0,
    "software - application": 0,
    "semiconductors": 2,
    "semiconductor equipment & materials": 2,
    "semiconductor memory": 2,
    "computer hardware": 1,
    "consumer electronics": 1,
    "electronic components": 4,
    "scientific & technical instruments": 4,
    "communication equipment": 4,
    "information technology services": 3,
    "internet content & information": 65,
    "internet retail": 25,
    "specialty retail": 24,
    "apparel retail": 24,
    "home improvement retail": 24,
    "department stores": 24,
    "discount stores": 30,
    "grocery stores": 30,
    "drug manufacturers—general": 7,
    "drug manufacturers—specialty & generic": 7,
    "biotechnology": 6,
    "medical devices": 8,
    "medical instruments & supplies": 8,
    "diagnostics & research": 10,
    "health information services": 11,
    "medical care facilities": 9,
    "banks—regional": 12,
    "banks—diversified": 12,
    "credit services": 15,
    "insurance—life": 13,
    "insurance—property & casualty": 13,
    "insurance—diversified": 13,
    "asset management": 14,
    "capital markets": 14,
    "financial data & stock exchanges": 17,
    "auto manufacturers": 18,
    "auto parts": 19,
    "recreational vehicles": 21,
    "gambling": 21,
    "resorts & casinos": 23,
    "restaurants": 23,
    "lodging": 23,
    "travel services": 23,
    "apparel manufacturing": 22,
    "footwear & accessories": 22,
    "luxury goods": 22,
    "household & personal products": 28,
    "packaged foods": 26,
    "beverages—non-alcoholic": 26,
    "beverages—brewers": 26,
    "beverages—wineries & distilleries": 26,
    "tobacco": 27,
    "aerospace & defense": 31,
    "airlines": 39,
    "railroads": 41,
    "trucking": 40,
    "integrated freight & logistics": 40,
    "marine shipping": 40,
    "farm & heavy construction machinery": 36,
    "specialty industrial machinery": 36,
    "metal fabrication": 36,
    "industrial distribution": 37,
    "security & protection services": 37,
    "staffing & employment services": 38,
    "consulting services": 38,
    "conglomerates": 35,
    "electrical equipment & parts": 34,
    "building products & equipment": 32,
    "engineering & construction": 33,
    "oil & gas e&p": 42,
    "oil & gas integrated": 43,
    "oil & gas refining & marketing": 44,
    "oil & gas equipment & services": 45,
    "oil & gas midstream": 43,
    "oil & gas drilling": 45,
    "solar": 46,
    "utilities—regulated electric": 47,
    "utilities—regulated gas": 48,
    "utilities—diversified": 49,
    "utilities—renewable": 51,
    "utilities—independent power producers": 51,
    "reit—residential": 52,
    "reit—retail": 52,
    "reit—office": 52,
    "reit—industrial": 52,
    "reit—healthcare facilities": 52,
    "reit—hotel & motel": 52,
    "reit—diversified": 52,
    "reit—mortgage": 53,
    "reit—specialty": 52,
    "real estate services": 54,
    "real estate—development": 55,
    "real estate—diversified": 54,
    "specialty chemicals": 56,
    "agricultural inputs": 56,
    "chemicals": 56,
    "building materials": 57,
    "packaging & containers": 58,
    "gold": 59,
    "silver": 59,
    "copper": 59,
    "other industrial metals & mining": 59,
    "steel": 59,
    "aluminum": 59,
    "coking coal": 59,
    "lumber & wood production": 60,
    "paper & paper products": 60,
    "telecom services": 61,
    "advertising agencies": 66,
    "broadcasting": 63,
    "entertainment": 64,
    "electronic gaming & multimedia": 64,
    "publishing": 67,
}

# Large symbols that lead their sector.
ANCHORS = {
    0: ["AAPL", "MSFT", "NVDA", "AVGO", "ORCL", "CRM", "ADBE", "AMD", "INTC", "CSCO"],
    1: ["JNJ", "UNH", "LLY", "PFE", "ABBV", "MRK", "TMO", "ABT", "DHR", "BMY"],
    2: ["JPM", "BAC", "WFC", "GS", "MS", "BLK", "SCHW", "C", "AXP", "SPGI"],
    3: ["AMZN", "TSLA", "HD", "MCD", "NKE", "LOW", "SBUX", "TJX", "BKNG", "CMG"],
    4: ["PG", "KO", "PEP", "COST", "WMT", "PM", "MO", "CL", "MDLZ", "KHC"],
    5: ["UNP", "HON", "UPS", "BA", "RTX", "CAT", "DE", "LMT", "GE", "MMM"],
    6: ["XOM", "CVX", "COP", "SLB", "EOG", "MPC", "PSX", "VLO", "OXY", "HAL"],
    7: ["NEE", "DUK", "SO", "D", "AEP", "SRE", "EXC", "XEL", "PEG", "ED"],
    8: ["PLD", "AMT", "EQIX", "CCI", "PSA", "O", "SPG", "WELL", "DLR", "AVB"],
    9: ["LIN", "APD", "SHW", "ECL", "FCX", "NEM", "NUE", "DD", "PPG", "VMC"],
    10: ["GOOGL", "META", "NFLX", "DIS", "CMCSA", "VZ", "T", "TMUS", "CHTR", "EA"],
}

# Symbol pairs that move together.
PAIRS = [
    ("NVDA", "AMD"),
    ("NVDA", "AVGO"),
    ("NVDA", "INTC"),
    ("AMD", "INTC"),
    ("AMAT", "LRCX"),
    ("AMAT", "KLAC"),
    ("LRCX", "KLAC"),
    ("AAPL", "MSFT"),
    ("GOOGL", "META"),
    ("AMZN", "MSFT"),
    ("JPM", "BAC"),
    ("JPM", "WFC"),
    ("BAC", "WFC"),
    ("GS", "MS"),
    ("XOM", "CVX"),
    ("COP", "EOG"),
    ("SLB", "HAL"),
    ("PFE", "MRK"),
    ("JNJ", "PFE"),
    ("LLY", "BMY"),
    ("WMT", "TGT"),
    ("HD", "LOW"),
    ("COST", "WMT"),
    ("DAL", "UAL"),
    ("DAL", "AAL"),
    ("UAL", "AAL"),
    ("LUV", "DAL"),
    ("GM", "F"),
    ("TSLA", "RIVN"),
    ("TSLA", "LCID"),
    ("CRM", "NOW"),
    ("ADBE", "CRM"),
    ("SNOW", "DDOG"),
    ("NFLX", "DIS"),
    ("NFLX", "WBD"),
    ("DIS", "PARA"),
    ("META", "SNAP"),
    ("META", "PINS"),
    ("COIN", "MARA"),
    ("COIN", "RIOT"),
    ("MARA", "RIOT"),
]

# Company names (lower case) -> ticker.
COMPANIES = {
    "apple": "AAPL",
    "apple inc": "AAPL",
    "apple computer": "AAPL",
    "microsoft": "MSFT",
    "microsoft corp": "MSFT",
    "microsoft corporation": "MSFT",
    "google": "GOOGL",
    "alphabet": "GOOGL",
    "alphabet inc": "GOOGL",
    "amazon": "AMZN",
    "amazon.com": "AMZN",
    "amazon inc": "AMZN",
    "meta": "META",
    "facebook": "META",
    "meta platforms": "META",
    "nvidia": "NVDA",
    "nvidia corp": "NVDA",
    "nvidia corporation": "NVDA",
    "tesla": "TSLA",
    "tesla inc": "TSLA",
    "tesla motors": "TSLA",
    "netflix": "NFLX",
    "netflix inc": "NFLX",
    "intel": "INTC",
    "intel corp": "INTC",
    "intel corporation": "INTC",
    "amd": "AMD",
    "advanced micro devices": "AMD",
}

# Known delistings.
MAJOR_DELISTINGS = [
    ("WCOM", "WorldCom", "fraud", 2002),
    ("ENRNQ", "Enron", "fraud", 2001),
    ("PETS", "Pets.com", "bankruptcy", 2000),
    ("ETYS", "eToys", "bankruptcy", 2001),
    ("WEBV", "Webvan", "bankruptcy", 2001),
    ("BRCM", "Broadcom (old)", "acquisition", 2016),
    ("LEHM", "Lehman Brothers", "bankruptcy", 2008),
    ("WAMUQ", "Washington Mutual", "bankruptcy", 2008),
    ("LK", "Luckin Coffee", "fraud", 2020),
    ("RIDE", "Lordstown Motors", "bankruptcy", 2023),
    ("BBED", "Bed Bath Beyond", "bankruptcy", 2023),
    ("SVB", "Silicon Valley Bank", "bankruptcy", 2023),
    ("FRC", "First Republic Bank", "acquisition", 2023),
    ("DIDI", "Didi Global", "compliance", 2022),
    ("SPCE", "Virgin Galactic", "compliance", 2024),
    ("BBRY", "BlackBerry", "acquisition", 2022),
    ("NOK", "Nokia (partial)", "compliance", 2012),
]


# The history layer's own list of delisted or nearly delisted symbols.
HISTORICAL_DELISTED = [
    ("WCOM", "WorldCom", "fraud_bankruptcy", 2002),
    ("ENRNQ", "Enron", "fraud_bankruptcy", 2001),
    ("GLW", "Global Crossing", "bankruptcy", 2002),
    ("LEH", "Lehman Brothers", "bankruptcy", 2008),
    ("BSC", "Bear Stearns", "acquired_distressed", 2008),
    ("WM", "Washington Mutual", "bankruptcy", 2008),
    ("CFC", "Countrywide Financial", "acquired_distressed", 2008),
    ("AIG", "AIG (old)", "restructured", 2008),
    ("HMNY", "Helios and Matheson (MoviePass)", "bankruptcy", 2019),
    ("LK", "Luckin Coffee", "fraud", 2020),
    ("RIDE", "Lordstown Motors", "bankruptcy", 2023),
    ("BBBYQ", "Bed Bath & Beyond", "bankruptcy", 2023),
    ("SIVBQ", "Silicon Valley Bank", "bankruptcy", 2023),
    ("FRCB", "First Republic Bank", "acquired_distressed", 2023),
    ("NKLA", "Nikola (near-delisting)", "fraud_ongoing", None),
    ("HYLN", "Hyliion", "spac_failure", None),
]


def delisting_list(spark: SparkSession, which: str = "major") -> DataFrame:
    """Known delistings as metadata rows: symbol, company_name, delist_reason, delist_year."""
    rows = HISTORICAL_DELISTED if which == "history" else MAJOR_DELISTINGS
    return spark.createDataFrame(rows, "symbol string, company_name string, delist_reason string, delist_year int")


def _dictionary(spark: SparkSession, rows, key: str, value: str, kind: str = "int") -> DataFrame:
    # code constants: the broadcast size is fixed
    return F.broadcast(spark.createDataFrame(list(rows), f"{key} string, {value} {kind}"))


def with_sector_id(df: DataFrame, sector: str = "sector", style: str = "alias") -> DataFrame:
    """Add ``sector_id``: by exact history spelling, or case-insensitive with aliases; -1 if unknown."""
    if style == "history":
        rows, text = HISTORY_SECTORS.items(), F.col(sector)
    else:
        rows = [(n.lower(), i) for i, (name, other) in SECTORS.items() for n in (name, *other)]
        text = F.trim(F.lower(sector))
    names = _dictionary(df.sparkSession, rows, "_name", "_sid")
    out = df.withColumn("_name", text).join(names, "_name", "left")
    return out.withColumn("sector_id", F.coalesce("_sid", F.lit(-1))).drop("_name", "_sid")


def with_industry_id(df: DataFrame, industry: str = "industry") -> DataFrame:
    """Add ``industry_id``: alias, then exact name, then the first name (by id) that contains the text or
    is contained in it; -1 if there is none or no text."""
    names = {n.lower(): i for i, (n, _) in enumerate(INDUSTRIES)}
    known = _dictionary(df.sparkSession, {**names, **INDUSTRY_ALIASES}.items(), "_name", "_iid")
    text = F.trim(F.lower(industry))
    out = df.withColumn("_name", text).join(known, "_name", "left")
    listed = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(i).alias("i")) for n, i in names.items()))
    alike = F.filter(listed, lambda e: F.contains(F.col("_name"), e["n"]) | F.contains(e["n"], F.col("_name")))
    found = F.when(F.col("_iid").isNotNull(), F.col("_iid")).otherwise(F.try_element_at(alike, F.lit(1))["i"])
    empty = F.col(industry).isNull() | (F.col(industry) == "")
    return out.withColumn("industry_id", F.when(empty, -1).otherwise(F.coalesce(found, F.lit(-1)))).drop("_name", "_iid")


def classify(df: DataFrame, sector: str = "sector", industry: str = "industry") -> DataFrame:
    """Sector and industry ids and names; a missing sector is taken from the industry."""
    out = with_industry_id(with_sector_id(df, sector), industry)
    of_industry = F.element_at(F.array(*(F.lit(s) for _, s in INDUSTRIES)), F.col("industry_id") + 1)
    repaired = (F.col("sector_id") < 0) & (F.col("industry_id") >= 0)
    names = F.array(*(F.lit(n) for n, _ in SECTORS.values()))
    out = out.withColumn("_repaired", repaired).withColumn(
        "sector_id", F.when(F.col("_repaired"), of_industry).otherwise(F.col("sector_id"))
    )
    name = F.when(F.col("_repaired"), F.element_at(names, F.col("sector_id") + 1)).otherwise(F.col(sector))
    blank = lambda c: F.when((c == "") | c.isNull(), "Unknown").otherwise(c)
    return out.withColumns({"sector_name": blank(name), "industry_name": blank(F.col(industry))}).drop("_repaired")


def classify_new(symbols: DataFrame, known: DataFrame, **how) -> DataFrame:
    """Classify only the symbols not in ``known`` (an earlier result), and return both together."""
    new = symbols.join(known.select("symbol"), "symbol", "left_anti")
    cols = ["symbol", "sector_id", "industry_id", "sector_name", "industry_name"]
    return known.select(*cols).unionByName(classify(new, **how).select(*cols))


def sector_stocks(classified: DataFrame, sector_id: int) -> DataFrame:
    return classified.filter(F.col("sector_id") == sector_id).select("symbol")


def industry_stocks(classified: DataFrame, industry_id: int) -> DataFrame:
    return classified.filter(F.col("industry_id") == industry_id).select("symbol")


def related_symbols(df: DataFrame, symbol: str = "symbol") -> DataFrame:
    """One row per (row, related symbol) over the symmetric pair list."""
    both = sorted({*PAIRS, *((b, a) for a, b in PAIRS)})
    edges = F.broadcast(df.sparkSession.createDataFrame(both, f"{symbol} string, related string"))
    return df.join(edges, symbol)


def sector_anchors(df: DataFrame, sector_id: str = "sector_id") -> DataFrame:
    """Add ``anchors``, the leading symbols of the row's sector (null if unknown)."""
    listed = F.array(*(F.array(*(F.lit(a) for a in names)) for names in ANCHORS.values()))
    return df.withColumn("anchors", F.when(F.col(sector_id) >= 0, F.try_element_at(listed, F.col(sector_id) + 1)))


def one_hot_sector(df: DataFrame, sector_id: str = "sector_id") -> DataFrame:
    """Add ``sector_onehot``, an array of 11 zeros and ones."""
    cell = lambda i: F.when(F.col(sector_id) == i, 1.0).otherwise(0.0)
    return df.withColumn("sector_onehot", F.transform(F.sequence(F.lit(0), F.lit(10)), cell))


def company_tickers(extra: dict[str, str] | None = None) -> Column:
    """The company dictionary as a map column (lower-case name -> ticker)."""
    rows = {**COMPANIES, **(extra or {})}
    return F.map_from_arrays(F.array(*(F.lit(k) for k in rows)), F.array(*(F.lit(v) for v in rows.values())))
