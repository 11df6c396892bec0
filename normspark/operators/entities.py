"""Relational records to triples: persons and committees with what they do and do not do."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normspark import values as v
from normspark.config import Config
from normspark.operators.keyed import newest

TRIPLE = ["s", "p", "o", "o_kind", "datatype"]

# --- latest records -------------------------------------------------------------------------


def _latest(records: DataFrame, by: str, ties: list[str], fields: list[str]) -> DataFrame:
    """Newest record per student; a missing date counts as newest, as in a descending sort."""
    order = [F.col(by).isNull(), F.col(by), *[F.col(t) for t in ties]]
    return newest(records, ["student_id"], order, fields)


FEE = ["payment_status", "first_installment_paid", "amount_paid", "tuition_amount"]
HOUSING = [
    "building", "room_number", "room_type", "deposit_paid", "rent_current", "with_spouse",
    "on_waiting_list", "provided_arrival_date", "room_clean", "common_area_clean",
    "unit_hygiene", "confirmed_offer", "vacated_on_time",
]


def latest_fee(fee_records: DataFrame, ties: list[str] | None = None) -> DataFrame:
    return _latest(fee_records, "semester", ties or [], FEE)


def latest_housing(accommodations: DataFrame, ties: list[str] | None = None) -> DataFrame:
    return _latest(accommodations, "check_in_date", ties or [], HOUSING)


def student_profiles(tables: dict[str, DataFrame], ties: dict[str, list[str]] | None = None):
    """Each student with the latest fee and housing record and the conduct and academic flags.

    All joins are left equi joins on student_id with one row per student on the right.
    """
    ties = ties or {}
    return (
        tables["students"]
        .join(latest_fee(tables["fee_records"], ties.get("fee_records")), "student_id", "left")
        .join(
            latest_housing(tables["accommodations"], ties.get("accommodations")),
            "student_id",
            "left",
        )
        .join(tables["student_conduct"], "student_id", "left")
        .join(tables["academic_records"], "student_id", "left")
    )


# --- flags ----------------------------------------------------------------------------------


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _unless_no(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(True))


def fee_flags() -> list[tuple[Column, list[str]]]:
    paid = F.coalesce(F.col("payment_status") == "Paid", F.lit(False))
    full = paid & F.coalesce(F.col("amount_paid") >= F.col("tuition_amount"), F.lit(False))
    # Properties of the fee flags.
    return [
        (paid, ["payFee"]),
        (_yes("first_installment_paid"), ["payFirstSemesterFee"]),
        (full, ["fullPayment", "paidinadvanceorfully", "feesPaid"]),
    ]


def housing_flags() -> list[tuple[Column, list[str]]]:
    housed = F.col("building").isNotNull()

    def good(name: str) -> Column:
        return F.when(housed, _yes(name)).otherwise(F.lit(True))

    # Properties of the housing flags.
    return [
        (housed & _yes("confirmed_offer"), ["confirmOfferMove"]),
        (housed & _yes("with_spouse"), ["moveWithSpouse"]),
        (housed & _yes("provided_arrival_date"), ["provideapproximatedateofarrivaloncampus"]),
        (good("rent_current"), ["payRentForStayOnCampus"]),
        (good("vacated_on_time"), ["vacatesRoom", "vacateRoom"]),
        (good("room_clean"), ["clean", "maintainCleanlinessOfBedroomAndFacilities"]),
        (good("unit_hygiene"), ["regularcleaningandhygieneoftheunit"]),
        (good("common_area_clean"), ["maintainCleanlinessOfCommonAreaAndLandscape"]),
    ]


def conduct_flags() -> list[tuple[Column, list[str]]]:
    # Properties of the conduct flags.
    return [
        (_unless_no("brings_concerns_to_attention"), ["bringConcernsToAttention"]),
        (
            _unless_no("ethical_conduct"),
            ["meetHighestStandardsOfPersonalEthicalAndMoralConduct"],
        ),
        (
            _unless_no("peaceful_environment"),
            ["maintainPeacefulHealthyLearningEnvironmentForFreeDiscussion"],
        ),
        (
            _unless_no("library_responsible_use"),
            ["useAITLibraryAndEducationalResourcesResponsibly"],
        ),
        (_unless_no("it_acceptable_use"), ["abideByAcceptableUsePolicyForITResources"]),
    ]


def prohibition_flags() -> list[tuple[Column, list[str]]]:
    # Properties of the prohibition flags.
    return [
        (_yes("cooking_in_dorm"), ["cookInUnit", "cookInProhibitedDormitory"]),
        (_yes("noisy_in_dorm"), ["noisyGroupStudyOrPartyInStudentAccommodation"]),
        (_yes("pet_in_dorm"), ["petInStudentAccommodation"]),
        (
            _yes("disturbing_residents"),
            ["disturbFellowStudentsInResidentialAreas", "disturbingpeace"],
        ),
    ]


def academic_flags() -> list[tuple[Column, list[str]]]:
    # Properties of the academic flags.
    return [
        (_unless_no("registered_with_registry"), ["registry"]),
        (_unless_no("grade_determined_in_courses"), ["determineGradeInCourse"]),
        (
            _unless_no("makeup_classes_scheduled"),
            ["scheduledoutsideregularhoursmakeupclasses"],
        ),
        (
            _yes("serves_as_corresponding_author"),
            ["serveAsCorrespondingAuthor", "correspondAsAuthorWithJournal"],
        ),
        (
            _yes("first_author_in_multi_authored"),
            [
                "multiAuthoredArticleWrittenByStudentShouldBeFirstAuthorUnless"
                "JournalRequiresDifferentOrder"
            ],
        ),
    ]


def faculty_flags() -> list[tuple[Column, list[str]]]:
    # Properties of the faculty flags.
    return [
        (_yes("grading_criteria_published"), ["makeKnownCriteriaForGrading"]),
        (_yes("follows_disciplinary_procedures"), ["followProceduresForDisciplinaryActions"]),
        (_yes("discloses_conflicts"), ["disclose"]),
        (
            _yes("reports_cheating_suspects"),
            ["suspectCheatingDuringExamOrAssignmentOrResearchProject", "reported"],
        ),
    ]


def staff_flags() -> list[tuple[Column, list[str]]]:
    # Properties of the staff flags; the last two hold for everyone.
    return [
        (_yes("gifts_reported"), ["reported"]),
        (_yes("settlements_reported"), ["settled"]),
        (_yes("fees_managed_properly"), ["feesPaid", "payFees"]),
        (
            _yes("ethical_authority_use"),
            [
                "usesAuthorityEthicallyWithRespectAndSensitivityAndInAccordance"
                "WithInstitutesPolicies",
                "disclose",
            ],
        ),
        (F.lit(True), ["expresses_personal_opinion", "undergoDisciplinaryAction"]),
    ]


def committee_values() -> list[tuple[Column, list[str]]]:
    active, grievances = _yes("is_active"), _yes("handles_grievances")
    records = _yes("records_facts")
    # Properties of the committee flags, written for true and for false.
    return [
        (_yes("chair_elected"), ["electsChair"]),
        (grievances, ["receive_grievance"]),
        (active & grievances, ["grievanceCommitteePerformsRole"]),
        (active, ["prepared"]),
        (_yes("maintains_confidentiality"), ["confidentiality_and_due_regard"]),
        (grievances, ["grievanceProcedureInvolvement"]),
        (records, ["writeDownGrievanceFacts", "recordFacts"]),
        (grievances, ["analyzeGrievance"]),
        (_yes("convenes_tribunals"), ["conveneGrievanceTribunal", "attendHearing"]),
        (
            records,
            [
                "ascertainFactsOfCase", "expressesInWriting",
                "submitWrittenAgreementsToGrievanceCommittee",
            ],
        ),
    ]


def _present(flags) -> list[Column]:
    """A (p, o) struct per property where its flag holds."""
    return [
        F.when(flag, F.struct(F.lit(name).alias("p"), F.lit("true").alias("o")))
        for flag, names in flags
        for name in names
    ]


def _valued(flags) -> list[Column]:
    return [
        F.struct(F.lit(name).alias("p"), flag.cast("string").alias("o"))
        for flag, names in flags
        for name in names
    ]


# --- entity rows ----------------------------------------------------------------------------


def _entity(df: DataFrame, key: Column, kind: Column, label: Column, props: list[Column], notes):
    return df.select(
        key.alias("entity_id"),
        kind.alias("class"),
        label.alias("label"),
        F.array_compact(F.array(*props)).alias("props"),
        F.array_compact(F.array(*notes)).alias("notes"),
    )


def student_entities(profiles: DataFrame) -> DataFrame:
    """Students as entities: class, label, properties in order and comment lines."""
    enrolled = F.coalesce(F.col("enrollment_status") == "Active", F.lit(False))
    fixed = _valued(
        [(F.lit(True), ["student"]), (enrolled, ["enrolled"]),
         (_yes("is_new_student"), ["newStudent"])]
    )
    flags = (
        fee_flags() + housing_flags() + conduct_flags() + prohibition_flags() + academic_flags()
    )
    kind = F.when(F.col("degree_level") == "PhD", "PostgraduateStudent").otherwise("Student")
    name = F.concat_ws(" ", "first_name", "last_name")
    label = F.concat(
        name, F.lit(" - "), F.coalesce("degree_level", F.lit("")), F.lit(" Student ("),
        F.col("enrollment_status"), F.lit(")"),
    )
    notes = [
        F.concat(F.lit("# -- "), name, F.lit(" ("), F.col("student_id"), F.lit(") --")),
        F.concat(
            F.lit("# Program: "), F.coalesce("program", F.lit("N/A")), F.lit(" | "),
            F.coalesce("degree_level", F.lit("N/A")), F.lit(" | Status: "),
            F.col("enrollment_status"),
        ),
        F.when(
            F.col("building").isNotNull(),
            F.concat(F.lit("# Housing: "), F.col("building"), F.lit(", Room "),
                     F.col("room_number")),
        ),
    ]
    return _entity(profiles, F.col("student_id"), kind, label, fixed + _present(flags), notes)


def faculty_entities(faculty: DataFrame) -> DataFrame:
    name = F.concat_ws(" ", "title", "first_name", "last_name")
    notes = [
        F.concat(F.lit("# -- "), name, F.lit(" ("), F.col("faculty_id"), F.lit(") --")),
        F.concat(
            F.lit("# Department: "), F.col("department"), F.lit(" | Position: "),
            F.col("position"),
        ),
    ]
    label = F.concat(name, F.lit(" - "), F.col("position"))
    return _entity(
        faculty, F.col("faculty_id"), F.lit("Faculty"), label, _present(faculty_flags()), notes
    )


def staff_entities(staff: DataFrame) -> DataFrame:
    name = F.concat_ws(" ", "first_name", "last_name")
    notes = [
        F.concat(F.lit("# -- "), name, F.lit(" ("), F.col("staff_id"), F.lit(") --")),
        F.concat(
            F.lit("# Department: "), F.col("department"), F.lit(" | Role: "), F.col("role")
        ),
    ]
    label = F.concat(name, F.lit(" - "), F.col("role"))
    return _entity(
        staff, F.col("staff_id"), F.lit("Employee"), label, _present(staff_flags()), notes
    )


def committee_id(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit(" "), F.lit("")), F.lit("&"), F.lit("And"))


def committee_entities(committees: DataFrame) -> DataFrame:
    name = F.col("committee_name")
    notes = [
        F.concat(F.lit("# -- "), name, F.lit(" --")),
        F.concat(F.lit("# Type: "), F.col("committee_type")),
    ]
    return _entity(
        committees, committee_id(name), F.lit("Committee"), name, _valued(committee_values()), notes
    )


def entities(
    tables: dict[str, DataFrame],
    entity_id: str | None = None,
    entity_type: str | None = None,
    ties: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One person of a kind, or all kinds together; the id filter reaches the scans."""
    person = {
        "Student": ("students", "student_id"),
        "Faculty": ("faculty", "faculty_id"),
        "Employee": ("staff", "staff_id"),
    }
    chosen = dict(tables)
    one = person.get(entity_type) if entity_id else None
    if one:
        table, key = one
        chosen[table] = tables[table].filter(F.col(key) == entity_id)
        if table == "students":
            for other in ("fee_records", "accommodations", "student_conduct", "academic_records"):
                chosen[other] = tables[other].filter(F.col("student_id") == entity_id)
    kinds = {
        "students": lambda: student_entities(student_profiles(chosen, ties)),
        "faculty": lambda: faculty_entities(chosen["faculty"]),
        "staff": lambda: staff_entities(chosen["staff"]),
        "committees": lambda: committee_entities(chosen["committees"]),
    }
    wanted = [one[0]] if one else list(kinds)
    parts = [kinds[k]().withColumn("section", F.lit(k)) for k in wanted]
    return reduce(DataFrame.unionByName, parts)


#: tables that hold one person's records, and their key
PERSON_KEYS = {
    "students": "student_id", "fee_records": "student_id", "accommodations": "student_id",
    "conduct_records": "student_id", "student_conduct": "student_id", "academic_records": "student_id",
    "faculty": "faculty_id", "staff": "staff_id",
}


def only_person(tables: dict[str, DataFrame], person_id: str) -> dict[str, DataFrame]:
    """The tables with the rows of one person, whatever the kind; the filter reaches the scans."""
    chosen = {k: t.filter(F.col(PERSON_KEYS[k]) == str(person_id)) for k, t in tables.items() if k in PERSON_KEYS}
    rest = {k: t.filter(F.lit(False)) for k, t in tables.items() if k not in PERSON_KEYS}
    return chosen | rest


def of_names(
    tables: dict[str, DataFrame],
    students: Sequence[str] = (),
    faculty: Sequence[str] = (),
    staff: Sequence[str] = (),
    committees: Sequence[str] = (),
    ties: dict[str, list[str]] | None = None,
) -> DataFrame:
    """The entities that are listed by name, as entities() gives all; kinds without a name give none."""
    chosen = tables | {
        "students": by_names(tables["students"], list(students)),
        "faculty": by_names(tables["faculty"], list(faculty), faculty_key()),
        "staff": by_names(tables["staff"], list(staff)),
        "committees": by_names(
            tables["committees"], list(committees), committee_id(F.col("committee_name"))
        ),
    }
    return entities(chosen, ties=ties)


def by_names(df: DataFrame, names: list[str], column: Column | None = None) -> DataFrame:
    """Rows whose name is listed: students by first name, faculty by title and names run together,
    staff by first name, committees by id."""
    return df.filter((F.col("first_name") if column is None else column).isin(names))


def faculty_key() -> Column:
    """Title and names run together, without blanks and dots."""
    joined = F.concat("title", "first_name", "last_name")
    return F.replace(F.replace(joined, F.lit(" "), F.lit("")), F.lit("."), F.lit(""))


# --- triples and text -----------------------------------------------------------------------


def triples(entity_rows: DataFrame, config: Config) -> DataFrame:
    """Type, label and property triples of entities, unpivoted row by row."""
    ns = F.lit(config.namespace)

    def triple(p: Column, o: Column, kind: str, datatype: Column) -> Column:
        return F.struct(
            p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), datatype.alias("datatype")
        )

    no_type = F.lit(None).cast("string")
    facts = F.concat(
        F.array(
            triple(F.lit(v.RDF_TYPE), F.concat(ns, F.col("class")), "iri", no_type),
            triple(F.lit(v.RDFS_LABEL), F.col("label"), "literal", F.lit("string")),
        ),
        F.transform(
            "props",
            lambda x: triple(F.concat(ns, x["p"]), x["o"], "literal", F.lit("boolean")),
        ),
    )
    return entity_rows.select(
        F.concat(ns, F.col("entity_id")).alias("s"), F.explode(facts).alias("t")
    ).select("s", "t.*")


def text_blocks(entity_rows: DataFrame, config: Config) -> DataFrame:
    """Turtle block of each entity, written from its own row."""
    p = config.prefix + ":"
    lines = F.concat(
        F.array(F.concat(F.lit('    rdfs:label "'), F.col("label"), F.lit('"'))),
        F.transform("props", lambda x: F.concat(F.lit("    " + p), x["p"], F.lit(" "), x["o"])),
    )
    block = F.concat(
        F.array_join("notes", "\n"),
        F.lit("\n" + p),
        F.col("entity_id"),
        F.lit(" a " + p),
        F.col("class"),
        F.lit(" ;\n"),
        F.array_join(lines, " ;\n"),
        F.lit(" .\n"),
    )
    return entity_rows.select("section", "entity_id", block.alias("block"))


def block_counts(entity_rows: DataFrame) -> DataFrame:
    """Number of entities and of property lines."""
    return entity_rows.agg(
        F.count("*").alias("entity_count"),
        F.coalesce(F.sum(F.size("props")), F.lit(0)).alias("property_count"),
    )


# --- lists ----------------------------------------------------------------------------------


def _overview(df: DataFrame, name, kind: str, label, properties: int, issues, status) -> DataFrame:
    issue_list = F.array_compact(F.array(*[F.when(c, t) for c, t in issues]))
    detail = F.when(F.size(issue_list) == 0, "No known issues").otherwise(
        F.array_join(issue_list, ", ")
    )
    if kind == "Student":
        detail = F.concat(status, F.lit(" | "), detail)
    return df.select(
        name.alias("name"),
        F.lit(kind).alias("type"),
        label.alias("label"),
        F.lit(properties).alias("properties"),
        detail.alias("detail"),
        status.alias("status"),
        F.size(issue_list).alias("issues"),
        (F.col("incidents") if kind == "Student" else F.lit(0).cast("long")).alias("incidents"),
    )


def overview(tables: dict[str, DataFrame], ties: dict[str, list[str]] | None = None) -> DataFrame:
    """Every entity with its label, status and list of known issues."""
    ties = ties or {}
    incidents = tables["conduct_records"].groupBy("student_id").agg(
        F.count("*").alias("incidents")
    )
    fee = latest_fee(tables["fee_records"], ties.get("fee_records")).select(
        "student_id", "payment_status"
    )
    conduct = tables["student_conduct"].select(
        "student_id", "cooking_in_dorm", "pet_in_dorm", "noisy_in_dorm", "disturbing_residents"
    )
    students = (
        tables["students"]
        .join(incidents, "student_id", "left")
        .join(fee, "student_id", "left")
        .join(conduct, "student_id", "left")
        .withColumns(
            {
                "payment_status": F.coalesce("payment_status", F.lit("N/A")),
                "incidents": F.coalesce("incidents", F.lit(0)),
            }
        )
    )

    def joined(*parts) -> Column:
        return F.concat(*[F.col(x[1:]) if x.startswith("$") else F.lit(x) for x in parts])

    # Issue texts of the overview.
    student_rows = _overview(
        students,
        F.col("first_name"),
        "Student",
        joined("$first_name", " ", "$last_name", " (", "$degree_level", " - ", "$program", ")"),
        30,
        [
            (
                F.col("payment_status").isin("Overdue", "Partial"),
                F.concat(F.lit("Fee: "), F.col("payment_status")),
            ),
            (_yes("cooking_in_dorm"), "Cooking violation"),
            (_yes("pet_in_dorm"), "Pet violation"),
            (_yes("noisy_in_dorm"), "Noise violation"),
            (_yes("disturbing_residents"), "Disturbing residents"),
        ],
        F.col("enrollment_status"),
    )
    faculty_rows = _overview(
        tables["faculty"],
        faculty_key(),
        "Faculty",
        joined("$title", " ", "$first_name", " ", "$last_name", " (", "$position", ", ",
               "$department", ")"),
        5,
        [
            (~_yes("grading_criteria_published"), "No grading criteria"),
            (~_yes("follows_disciplinary_procedures"), "No disciplinary procedures"),
            (~_yes("discloses_conflicts"), "Undisclosed conflicts"),
            (~_yes("reports_cheating_suspects"), "Not reporting cheating"),
        ],
        F.lit("Active"),
    )
    staff_rows = _overview(
        tables["staff"],
        F.col("first_name"),
        "Employee",
        joined("$first_name", " ", "$last_name", " (", "$role", ", ", "$department", ")"),
        7,
        [
            (~_yes("gifts_reported"), "Unreported gifts"),
            (~_yes("settlements_reported"), "Unsettled obligations"),
            (~_yes("ethical_authority_use"), "Authority misuse"),
        ],
        F.lit("Active"),
    )
    committee_rows = _overview(
        tables["committees"],
        committee_id(F.col("committee_name")),
        "Committee",
        joined("$committee_name", " (", "$committee_type", ")"),
        14,
        [(~_yes("chair_elected"), "No chair elected")],
        F.lit("Active"),
    )
    return reduce(
        DataFrame.unionByName, [student_rows, faculty_rows, staff_rows, committee_rows]
    )


def persons(tables: dict[str, DataFrame]) -> DataFrame:
    """Students, faculty and staff as (id, name, type, ord); committees are not persons.

    ord ranks a person within the listing order: kind, then the order of the kind.
    """

    def listed(table: str, key: str, kind: str, rank: int, name: Column, order: Column):
        return tables[table].select(
            F.col(key).alias("id"),
            F.trim(name).alias("name"),
            F.lit(kind).alias("type"),
            F.lit(rank).alias("rank"),
            order.cast("string").alias("ord"),
        )

    plain = F.concat_ws(" ", "first_name", "last_name")
    titled = F.concat_ws(" ", "title", "first_name", "last_name")
    return reduce(
        DataFrame.unionByName,
        [
            listed("students", "student_id", "Student", 0, plain, F.col("student_id")),
            listed("faculty", "faculty_id", "Faculty", 1, titled, F.format_string("%020d", "id")),
            listed("staff", "staff_id", "Employee", 2, plain, F.format_string("%020d", "id")),
        ],
    )


def person_by_name(person_rows: DataFrame, name: str) -> DataFrame:
    """The first person of exactly that name, else the first whose name contains it."""
    wanted = name.strip().lower()
    low = F.lower("name")
    rank = F.when(low == wanted, 0).when(low.contains(wanted), 1)
    ranked = person_rows.withColumn("match_rank", rank).filter(F.col("match_rank").isNotNull())
    if not wanted:
        ranked = ranked.filter(F.lit(False))
    return ranked.orderBy("match_rank", "rank", "ord").limit(1)


def person_by_id(person_rows: DataFrame, person_id) -> DataFrame:
    return person_rows.filter(F.col("id") == str(person_id))


def entity_total(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of entities of all kinds; a kind without table counts 0."""
    kinds = ("students", "faculty", "staff", "committees")
    counts = [
        tables[k].agg(F.count("*").alias("n")) for k in kinds if tables.get(k) is not None
    ]
    if not counts:
        raise ValueError("no entity table given")
    return reduce(DataFrame.unionByName, counts).agg(F.sum("n").alias("entities"))
