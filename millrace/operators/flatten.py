"""Flatten nested records with a declarative list of fields."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.collections import find, first_element, join_non_blank, localized
from millrace.functions.dates import compact, parts_to_compact, parts_to_iso
from millrace.operators.lookup import lookup, lookup_many, primary_or_all


@dataclass(frozen=True)
class FlattenField:
    """One output column.

    ``path`` walks struct fields. On an array, ``match`` picks the first element that
    satisfies it (``None`` picks element 0), or ``join`` joins all of them with that
    separator; ``then`` continues the walk inside the picked element. ``default``
    replaces a null or blank result.
    """

    name: str
    path: str
    match: Callable[[Column], Column] | None = None
    then: str | Callable[[Column], Column] | None = None
    join: str | None = None
    pick: bool = False
    default: str | None = ""

    def column(self) -> Column:
        value = _walk(F.col(self.path.split(".")[0]), self.path.split(".")[1:])
        if self.join is not None:
            inner = value if self.match is None else F.filter(value, self.match)
            return join_non_blank(F.transform(inner, self._inside), self.join).alias(self.name)
        if self.match is not None:
            value = self._inside(find(value, self.match))
        elif self.pick:
            value = self._inside(first_element(value))
        if self.default is not None:
            value = F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit(self.default))
        return value.alias(self.name)

    def _inside(self, element: Column) -> Column:
        if self.then is None:
            return element
        if callable(self.then):
            return self.then(element)
        return _walk(element, self.then.split("."))


def _walk(column: Column, steps: Sequence[str]) -> Column:
    for step in steps:
        column = column.getField(step)
    return column


def flatten(df: DataFrame, fields: Sequence[FlattenField], extra: Sequence[Column] = ()) -> DataFrame:
    return df.select(*[f.column() for f in fields], *extra)


def full_name(person: Column) -> Column:
    """First and last name, trimmed; missing parts are left out."""
    name = person.getField("name")
    blank = F.lit("")
    return F.trim(F.concat(F.coalesce(name.getField("firstName"), blank), F.lit(" "),
                           F.coalesce(name.getField("lastName"), blank)))


_LOCAL_TERM = "struct<en_GB:string,zh_CN:string>"
_TYPED_TERM = f"struct<uri:string,term:{_LOCAL_TERM}>"
_PERSON_REF = ("struct<name:struct<firstName:string,lastName:string>,"
               "person:struct<uuid:string>,externalPerson:struct<uuid:string>>")

# The nested source record, and the two tables it refers to, as DDL text.
RECORD_DDL = (
    "pureId bigint, uuid string, portalUrl string, version string, createdBy string,"
    "createdDate string, modifiedBy string, modifiedDate string, title struct<value:string>,"
    f"language {_TYPED_TERM}, type {_TYPED_TERM}, abstract {_LOCAL_TERM},"
    f"visibility struct<key:string,description:{_LOCAL_TERM}>,"
    f"workflow struct<step:string,description:{_LOCAL_TERM}>,"
    "awardDate struct<year:int,month:int,day:int>,"
    "identifiers array<struct<typeDiscriminator:string,idSource:string,value:string>>,"
    "prettyUrlIdentifiers array<string>,"
    f"contributors array<{_PERSON_REF}>, supervisors array<{_PERSON_REF}>,"
    "organizations array<struct<uuid:string>>, supervisorOrganizations array<struct<uuid:string>>,"
    "managingOrganization struct<uuid:string>,"
    "awardingInstitutions array<struct<externalOrganizationRef:struct<uuid:string>>>,"
    "keywordGroups array<struct<typeDiscriminator:string,logicalName:string,"
    f"classifications:array<{_TYPED_TERM}>,"
    "keywords:array<struct<locale:string,freeKeywords:array<string>>>>>,"
    "documents array<struct<fileId:string,fileName:string,mimeType:string,size:bigint,url:string,"
    "embargoDate:string,visibility:struct<key:string>>>")
PERSON_DDL = (
    "uuid string, studentOrganizationAssociations array<struct<affiliationId:string,"
    "organization:struct<uuid:string>,period:struct<startDate:string,endDate:string>,"
    "primaryAssociation:boolean>>")
ORGANISATION_DDL = f"uuid string, name {_LOCAL_TERM}"


def kept_documents(documents: Column, marker: str = "changehistory") -> Column:
    """Documents that have a file id and are not a change history."""
    return F.coalesce(
        F.filter(documents, lambda d: (F.coalesce(d.getField("fileId"), F.lit("")) != "")
                 & ~F.coalesce(d.getField("fileName").contains(marker), F.lit(False))),
        F.array().cast("array<struct<fileId:string,fileName:string,mimeType:string,size:bigint,"
                       "url:string,embargoDate:string,visibility:struct<key:string>>>"))


def record_fields() -> list[FlattenField]:
    """The standard flat columns of the nested record that need no lookup."""
    plain = ["uuid", "portalUrl", "version", "createdBy", "createdDate", "modifiedBy", "modifiedDate"]
    fields = [FlattenField(name, name) for name in plain]
    fields += [
        FlattenField("pureId", "pureId", default=None),
        FlattenField("title", "title.value"),
        FlattenField("prettyUrlIdentifiers", "prettyUrlIdentifiers", join=", "),
        FlattenField("author", "contributors", pick=True, then=full_name),
        FlattenField("authorFirst", "contributors", pick=True, then="name.firstName"),
        FlattenField("authorLast", "contributors", pick=True, then="name.lastName"),
        FlattenField("allAuthors", "contributors", join="; ", then=full_name),
        FlattenField("supervisor", "supervisors", join=", ", then=full_name),
        FlattenField("supervisorOrgUuids", "supervisorOrganizations", join=",", then="uuid"),
        FlattenField("firstOrgUuid", "organizations", pick=True, then="uuid"),
        FlattenField("managingOrgUuid", "managingOrganization.uuid"),
        FlattenField("awardingInstitution", "awardingInstitutions", pick=True,
                     then="externalOrganizationRef.uuid"),
        FlattenField("degreeEn", "type.term.en_GB"),
        FlattenField("degreeZh", "type.term.zh_CN"),
        FlattenField("language", "language.term.en_GB"),
        FlattenField("languageZh", "language.term.zh_CN"),
        FlattenField("abstract_en", "abstract.en_GB"),
        FlattenField("abstract_cn", "abstract.zh_CN"),
        FlattenField("visibility", "visibility.key"),
        FlattenField("visibilityDesc", "visibility.description.en_GB"),
        FlattenField("visibilityDescZh", "visibility.description.zh_CN"),
        FlattenField("status", "workflow.step"),
        FlattenField("statusDesc", "workflow.description.en_GB"),
        FlattenField("statusDescZh", "workflow.description.zh_CN"),
    ]
    return fields


def record_columns(download_base: str) -> list[Column]:
    """Flat columns that combine several paths of the nested record."""
    primary = find(F.col("identifiers"), lambda i: i.getField("typeDiscriminator") == "PrimaryId")
    contributor = first_element(F.col("contributors"))
    supervisor = first_element(F.col("supervisors"))

    def person_id(person: Column) -> Column:
        return F.coalesce(F.nullif(person.getField("person").getField("uuid"), F.lit("")),
                          F.nullif(person.getField("externalPerson").getField("uuid"), F.lit("")),
                          F.lit(""))

    def group(kind: str, logical: str) -> Column:
        return find(F.col("keywordGroups"), lambda g: (g.getField("typeDiscriminator") == kind)
                    & (g.getField("logicalName") == logical))

    words = find(group("FreeKeywordsKeywordGroup", "keywordContainers").getField("keywords"),
                 lambda k: k.getField("locale") == "en_GB").getField("freeKeywords")
    subjects = group("ClassificationsKeywordGroup", "librarySubjects").getField("classifications")
    files = kept_documents(F.col("documents"))
    first_file = first_element(files)
    award = F.col("awardDate")
    parts = [award.getField(p) for p in ("year", "month", "day")]
    url = F.when(F.coalesce(first_file.getField("fileId"), F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(f"{download_base}/records/"), F.col("uuid"), F.lit("/files/"),
                 first_file.getField("fileId")))

    def or_blank(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(""))

    return [
        F.coalesce(F.nullif(primary.getField("value"), F.lit("")), F.col("uuid"), F.lit("")).alias("id"),
        person_id(contributor).alias("authorPersonId"),
        person_id(supervisor).alias("supervisorPersonId"),
        F.coalesce(F.to_json(F.col("identifiers")), F.lit("")).alias("allIdentifiers"),
        F.coalesce(F.array_join(words, ", "), F.lit("")).alias("keywords"),
        join_non_blank(F.transform(subjects, lambda s: s.getField("term").getField("en_GB")), ", "
                       ).alias("subjects"),
        join_non_blank(F.transform(subjects, lambda s: s.getField("term").getField("zh_CN")), ", "
                       ).alias("subjectsZh"),
        award.getField("year").alias("publishYear"),
        F.when(award.isNull(), F.lit("")).otherwise(parts_to_iso(*parts)).alias("awardDay"),
        F.when(award.isNull(), F.lit("")).otherwise(parts_to_compact(*parts)).alias("publicationDate"),
        F.size(files).alias("pdf_count"),
        or_blank(url).alias("pdf_url"),
        or_blank(first_file.getField("fileName")).alias("pdf_fileName"),
        F.coalesce(first_file.getField("size"), F.lit(0)).alias("pdf_size"),
        or_blank(first_file.getField("embargoDate")).alias("docEmbargoDate"),
        or_blank(first_file.getField("visibility").getField("key")).alias("docVisibility"),
    ]


def with_download_urls(download_base: str) -> Column:
    """The record's documents, each with the address it can be fetched from."""
    def add(d: Column) -> Column:
        known = (F.coalesce(d.getField("fileId"), F.lit("")) != "") & (F.coalesce(F.col("uuid"), F.lit("")) != "")
        return d.withField("downloadUrl", F.when(known, F.concat(
            F.lit(f"{download_base}/records/"), F.col("uuid"), F.lit("/files/"), d.getField("fileId"))))

    return F.transform("documents", add)


def person_links(persons: DataFrame, organisations: DataFrame) -> DataFrame:
    """Per person: student id, end of enrolment, and the names of the organisations they belong to.

    The first association with an id gives the student id, the first one the end date.
    Organisations are those of the primary associations, or of all when none is primary.
    """
    links = F.col("studentOrganizationAssociations")
    with_id = find(links, lambda a: F.coalesce(a.getField("affiliationId"), F.lit("")) != "")
    ids = F.filter(F.transform(primary_or_all(links, "primaryAssociation"),
                               lambda a: a.getField("organization").getField("uuid")),
                   lambda uuid: F.coalesce(uuid, F.lit("")) != "")
    flat = persons.select(
        F.col("uuid").alias("person_uuid"), F.coalesce(with_id.getField("affiliationId"), F.lit("")).alias("student_id"),
        F.coalesce(first_element(links).getField("period").getField("endDate"), F.lit("")).alias("enrolment_end"),
        ids.alias("_organisations"))
    named = lookup_many(flat, organisations, "person_uuid", F.col("_organisations"), "uuid",
                        localized(F.col("name")), "college")
    return named.drop("_organisations")


def enrich_record(records: DataFrame, persons: DataFrame, organisations: DataFrame) -> DataFrame:
    """Add what the first contributor's person record tells, and whether that failed.

    ``enrich_failed`` is set when a person is named but has no student id, or when no
    organisation name was found.
    """
    keyed = records.withColumn("_person", first_element(F.col("contributors")).getField("person").getField("uuid"))
    found = lookup(keyed, person_links(persons, organisations), "_person", "person_uuid",
                   {"student_id": "student_id", "enrolment_end": "enrolment_end", "college": "college"})
    blank = F.lit("")
    out = found.withColumns({name: F.coalesce(F.col(name), blank)
                             for name in ("student_id", "enrolment_end", "college")})
    person_failed = (F.coalesce(F.col("_person"), blank) != "") & (F.col("student_id") == "")
    return out.withColumn("enrich_failed", person_failed | (F.col("college") == "")).drop("_person")


def flatten_enriched(records: DataFrame, download_base: str = "") -> DataFrame:
    """Flat columns of an enriched record; looked-up values go before the record's own."""
    carried = ["student_id", "enrolment_end", "college", "enrich_failed"]
    flat = flatten(records, record_fields(), [*record_columns(download_base), *carried])
    return flat.withColumns({
        "authorPersonId": F.coalesce(F.nullif("student_id", F.lit("")), F.col("authorPersonId")),
        "orgUuid": F.coalesce(F.nullif("college", F.lit("")), F.col("firstOrgUuid")),
        "submissionDate": F.coalesce(F.nullif(compact(F.col("enrolment_end")), F.lit("")), F.col("publicationDate")),
    })


def flatten_record(df: DataFrame, download_base: str = "") -> DataFrame:
    return flatten(df, record_fields(), record_columns(download_base))
