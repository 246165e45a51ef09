"""Schemas of the stored tables. Missing text is '', a missing year 0."""

AUTHOR = "struct<first_name:string,last_name:string,initials:string,affiliation:string,orcid:string,fore_name:string>"
MESH = "struct<descriptor_name:string,qualifier_names:array<string>,major_topic:boolean>"
IDENTITY = (
    "person_id string, first_name string, last_name string, middle_name string, primary_email string, primary_institution string, "
    "department string, title string, orcid string, bachelor_year int, doctoral_year int"
)
ARTICLE = (
    f"pmid long, title string, journal string, journal_issn array<string>, pub_year int, pub_date string, entry_date date, authors array<{AUTHOR}>, "
    f"mesh array<{MESH}>, keywords array<string>, grants array<string>, publication_types array<string>, doi string, abstract string"
)
LINK = "person_id string, pmid long, target_author_index int, source string"
CURATION = "person_id string, pmid long, assertion string, source string"
SCORE = "person_id string, pmid long, model_type string, calibrated_score double, raw_score double, scored_at timestamp, run_id long"
RETRIEVAL_LOG = "person_id string, last_retrieval_date date, last_orcid_retrieval_date date, articles_found long, run_id long"
