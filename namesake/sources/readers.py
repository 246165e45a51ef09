"""Readers of rosters, decision lists, bibliographic XML and lookup tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.strings import strip, year_in

TEXT = ["person_id", "first_name", "last_name", "middle_name", "primary_email", "primary_institution", "department", "title", "orcid"]
YEARS = ["bachelor_year", "doctoral_year"]
# Names that a header may have for each field, without case, spaces, hyphens and dots.
ALIASES = {
    "person_id": ["personid", "person_id", "uid", "userid", "employeeid", "empid", "emp_id", "cwid", "netid", "id"],
    "first_name": ["firstname", "first_name", "fname", "first", "givenname"],
    "last_name": ["lastname", "last_name", "lname", "last", "surname", "familyname"],
    "middle_name": ["middlename", "middle_name", "middleinitial", "middle_initial", "middle", "mi", "middleinit"],
    "primary_email": ["email", "primaryemail", "primary_email", "emailaddress", "email_address"],
    "primary_institution": ["institution", "primaryinstitution", "primary_institution"],
    "department": ["department", "dept", "division", "organizationalunit", "organizational_unit", "org_unit"],
    "title": ["title", "rank", "academictitle", "academic_title", "jobtitle", "job_title", "position"],
    "orcid": ["orcid", "orcidid", "orcid_id", "orcidurl", "orcid_url"],
    "bachelor_year": ["bacheloryear", "bachelor_year", "bsyear", "bs_year"],
    "doctoral_year": ["doctoralyear", "doctoral_year", "phdyear", "phd_year", "degreeyear", "degree_year"],
    "pmid": ["pmid", "pubmedid", "pubmed_id"],
    "assertion": ["assertion", "assertionstatus", "assertion_status", "userassertion", "user_assertion", "status"],
}


def detect_mappings(headers: list[str]) -> dict[str, str]:
    """header -> field; the first header that claims a field has it, later ones are left out."""
    field = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
    out: dict[str, str] = {}
    for h in headers:
        name = field.get(h.lower().strip().replace("-", "").replace(".", "").replace(" ", ""))
        if name and name not in out.values():
            out[h] = name
    return out


def _open_quotes(spark: SparkSession, path: str) -> bool:
    """Whether a line of the files has an odd number of quotes: only then a quoted field can go on over line breaks."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _table(spark: SparkSession, path: str, mappings: dict[str, str] | None) -> DataFrame:
    """CSV files, or TSV files where commas give one column, all as text under the fields' names, with each row's position.

    The position is the file's path, the place in the file where the row's split begins, and a number that grows along the
    split: it orders the rows by file name and line however Spark packs files into tasks. Files without a line break
    within quotes are read line by line, in many tasks; a file that has one is read by one task.
    """
    whole = _open_quotes(spark, path)
    read = lambda sep: spark.read.csv(path, header=True, sep=sep, multiLine=whole, escape='"')
    df = read(",")
    if len(df.columns) <= 1:
        df = read("\t")
    found = mappings or detect_mappings(df.columns)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return df.select(*[F.col(f"`{h}`").alias(name) for h, name in found.items()], place.alias("position"))


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(strip(F.col(name)), F.lit("")) if name in df.columns else F.lit("")


def _year(df: DataFrame, name: str) -> Column:
    return F.coalesce(_text(df, name).try_cast("double").cast("int"), F.lit(0))


def read_roster(spark: SparkSession, path: str, mappings: dict[str, str] | None = None) -> DataFrame:
    """Identities of a file with any known headers; rows without id, first or last name are left out.

    pmid and assertion stay as columns where the file has them (split_roster takes them apart); position is the row's place.
    """
    df = _table(spark, path, mappings)
    gold = [_text(df, c).alias(c) for c in ("pmid", "assertion") if c in df.columns]
    rows = df.select(*[_text(df, c).alias(c) for c in TEXT], *[_year(df, c).alias(c) for c in YEARS], *gold, "position")
    return rows.filter("person_id <> '' and first_name <> '' and last_name <> ''")


def decisions(df: DataFrame) -> DataFrame:
    """person_id, pmid, assertion: pmids as whole numbers (rows without one go), assertions other than ACCEPTED and
    REJECTED as ''."""
    mark = F.upper(strip(F.col("assertion"))) if "assertion" in df.columns else F.lit("")
    pmid = F.col("pmid").try_cast("double").cast("long")
    rows = df.select(strip(F.col("person_id")).alias("person_id"), pmid.alias("pmid"), F.when(mark.isin("ACCEPTED", "REJECTED"), mark).otherwise("").alias("assertion"))
    return rows.filter("pmid is not null and person_id <> ''")


def split_roster(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a roster with decisions in it: the last row of each person, and the decisions."""
    last = F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("position")))
    people = df.withColumn("_n", last).filter("_n = 1").drop("_n", "pmid", "assertion", "position")
    return people, decisions(df).filter("assertion <> ''")


def read_pmid_list(spark: SparkSession, path: str, mappings: dict[str, str] | None = None) -> DataFrame:
    return decisions(_table(spark, path, mappings))


_PERSON_XML = (
    "struct<LastName:string,ForeName:string,Initials:string,AffiliationInfo:array<struct<Affiliation:string>>,"
    "Identifier:array<struct<_Source:string,_VALUE:string>>>"
)
_FLAGGED = "struct<_MajorTopicYN:string,_VALUE:string>"
_VALUED = "struct<_VALUE:string>"
_DAY = "struct<Year:string,Month:string,Day:string,MedlineDate:string>"
RECORD = (
    f"MedlineCitation struct<PMID:{_VALUED},Article:struct<Journal:struct<ISSN:{_VALUED},Title:string,JournalIssue:struct<PubDate:{_DAY}>>,"
    f"ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,AuthorList:struct<Author:array<{_PERSON_XML}>>,"
    f"PublicationTypeList:struct<PublicationType:array<{_VALUED}>>,GrantList:struct<Grant:array<struct<GrantID:string>>>,"
    f"ELocationID:array<struct<_EIdType:string,_VALUE:string>>>,"
    f"MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:{_FLAGGED},QualifierName:array<{_FLAGGED}>>>>,"
    f"KeywordList:struct<Keyword:array<{_VALUED}>>,DateCompleted:{_DAY},DateRevised:{_DAY}>, "
    f"PubmedData struct<History:struct<PubMedPubDate:array<struct<_PubStatus:string,Year:string,Month:string,Day:string>>>>"
)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _list(c: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(c, F.array().cast(kind))


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles of bibliographic XML files, one record per PubmedArticle element; records without pmid or article go.

    The first abstract section, one ISSN, the year or the number that a free date begins with; of authors the first
    affiliation, the first word of the forename (all of it as fore_name) and the ORCID, of an address its last part; a
    heading is major if it or a qualifier is flagged.
    """
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(RECORD).load(path)
    c, a = F.col("MedlineCitation"), F.col("MedlineCitation.Article")
    rows = raw.filter(c["PMID"]["_VALUE"].isNotNull() & a.isNotNull())
    day = a["Journal"]["JournalIssue"]["PubDate"]

    def author(x: Column) -> Column:
        fore = _or_empty(x["ForeName"])
        ids = F.filter(_list(x["Identifier"], "array<struct<_Source:string,_VALUE:string>>"), lambda i: i["_Source"] == "ORCID")
        given = strip(_or_empty(F.get(ids, F.lit(0))["_VALUE"]))
        orcid = F.when(given.startswith("http"), F.element_at(F.split(F.rtrim(given, F.lit("/")), "/"), -1)).otherwise(given)
        return F.struct(
            _or_empty(F.get(F.split(strip(fore), r"\s+"), F.lit(0))).alias("first_name"), _or_empty(x["LastName"]).alias("last_name"), _or_empty(x["Initials"]).alias("initials"),
            _or_empty(F.get(x["AffiliationInfo"], F.lit(0))["Affiliation"]).alias("affiliation"), orcid.alias("orcid"), fore.alias("fore_name"),
        )

    def heading(x: Column) -> Column:
        qualifiers = _list(x["QualifierName"], f"array<{_FLAGGED}>")
        major = (x["DescriptorName"]["_MajorTopicYN"] == "Y") | F.exists(qualifiers, lambda q: q["_MajorTopicYN"] == "Y")
        return F.struct(x["DescriptorName"]["_VALUE"].alias("descriptor_name"), F.transform(qualifiers, lambda q: q["_VALUE"]).alias("qualifier_names"), F.coalesce(major, F.lit(False)).alias("major_topic"))

    values = lambda x: F.filter(F.transform(_list(x, f"array<{_VALUED}>"), lambda v: v["_VALUE"]), lambda v: v.isNotNull())
    location = F.filter(_list(a["ELocationID"], "array<struct<_EIdType:string,_VALUE:string>>"), lambda e: e["_EIdType"] == "doi")
    entered = F.filter(F.col("PubmedData.History.PubMedPubDate"), lambda d: d["_PubStatus"] == "entrez")
    first = F.get(entered, F.lit(0))
    year = F.when(day["Year"].rlike(r"^\d+$"), day["Year"].try_cast("int")).otherwise(year_in(_or_empty(day["MedlineDate"])))
    return rows.select(
        c["PMID"]["_VALUE"].try_cast("long").alias("pmid"),
        _or_empty(a["ArticleTitle"]).alias("title"),
        _or_empty(a["Journal"]["Title"]).alias("journal"),
        F.filter(F.array(a["Journal"]["ISSN"]["_VALUE"]), lambda i: i.isNotNull()).alias("journal_issn"),
        F.coalesce(year, F.lit(0)).alias("pub_year"),
        F.concat_ws(" ", day["Year"], day["Month"], day["Day"], day["MedlineDate"]).alias("pub_date"),
        F.try_to_date(F.concat_ws("-", first["Year"], first["Month"], first["Day"]), "y-M-d").alias("entry_date"),
        F.transform(_list(a["AuthorList"]["Author"], f"array<{_PERSON_XML}>"), author).alias("authors"),
        F.transform(_list(c["MeshHeadingList"]["MeshHeading"], f"array<struct<DescriptorName:{_FLAGGED},QualifierName:array<{_FLAGGED}>>>"), heading).alias("mesh"),
        values(c["KeywordList"]["Keyword"]).alias("keywords"),
        F.filter(F.transform(_list(a["GrantList"]["Grant"], "array<struct<GrantID:string>>"), lambda g: g["GrantID"]), lambda g: g.isNotNull()).alias("grants"),
        values(a["PublicationTypeList"]["PublicationType"]).alias("publication_types"),
        _or_empty(F.element_at(F.when(F.size(location) > 0, location), -1)["_VALUE"]).alias("doi"),
        _or_empty(F.get(a["Abstract"]["AbstractText"], F.lit(0))).alias("abstract"),
    ).filter("pmid is not null")


#: The fields of the lookup files, by what they hold.
FIELDS = {
    "score": "score", "name": "name", "gender": "gender", "probability": "probability", "issn": ["issn", "eissn"],
    "subfield": "scienceMetrixSubfield", "department": "primaryDepartment", "department_subfield": "scienceMetrixJournalSubfield",
}


def _last(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the last by _place; the column goes."""
    values = [c for c in rows.columns if c not in (key, "_place")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*values), "_place").alias("_v"))
    return last.select(key, "_v.*")


def load_lookups(spark: SparkSession, paths: dict[str, str], fields: dict | None = None) -> dict[str, DataFrame]:
    """Lookup tables of the JSON files given.

    name_frequency (name, score) from an object {name: {score}}, names as they are; gender (name, gender, probability) from a
    list of objects, names in lower case; subfields (issn, subfield) from a list of objects whose ISSNs of either kind
    lose hyphens and case; departments (department, subfield) from a list of pairs. `fields` renames the objects' fields.
    Entries without a key or subfield go, and of equal keys the last entry of the file counts.
    """
    f = FIELDS | (fields or {})
    objects = lambda path, names: spark.read.json(path, schema=", ".join(f"`{n}` string" for n in names), multiLine=True).withColumn("_place", F.monotonically_increasing_id())
    text = lambda name: F.coalesce(F.col(f"`{name}`"), F.lit(""))
    out = {}
    if "name_frequency" in paths:
        whole = spark.read.text(paths["name_frequency"], wholetext=True)
        pairs = F.map_entries(F.from_json("value", f"map<string,struct<`{f['score']}`:double>>"))
        each = whole.select(F.posexplode(pairs).alias("_place", "e")).select(F.col("e.key").alias("name"), F.col("e.value")[f["score"]].alias("score"), "_place")
        out["name_frequency"] = _last(each, "name")
    if "gender" in paths:
        rows = objects(paths["gender"], [f["name"], f["gender"], f["probability"]])
        sure = F.coalesce(text(f["probability"]).try_cast("double"), F.lit(0.0))
        each = rows.select(F.lower(text(f["name"])).alias("name"), text(f["gender"]).alias("gender"), sure.alias("probability"), "_place")
        out["gender"] = _last(each.filter("name <> ''"), "name")
    if "subfields" in paths:
        rows = objects(paths["subfields"], [*f["issn"], f["subfield"]])
        each = rows.select(F.posexplode(F.array(*[text(n) for n in f["issn"]])).alias("_kind", "issn"), text(f["subfield"]).alias("subfield"), "_place")
        keyed = each.select(F.lower(F.replace(F.col("issn"), F.lit("-"), F.lit(""))).alias("issn"), "subfield", F.struct("_place", "_kind").alias("_place"))
        out["subfields"] = _last(keyed.filter("issn <> '' and subfield <> ''"), "issn")
    if "departments" in paths:
        rows = objects(paths["departments"], [f["department"], f["department_subfield"]])
        pairs = rows.select(F.lower(text(f["department"])).alias("department"), text(f["department_subfield"]).alias("subfield"))
        out["departments"] = pairs.filter("department <> '' and subfield <> ''").distinct()
    return out
