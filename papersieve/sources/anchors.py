"""The discipline taxonomy as a small dimension."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Nine disciplines and the sub-fields that describe them.
DISCIPLINES = {
    "Agriculture, Biology & Environmental Sciences": [
        "Agriculture/Agronomy", "Agricultural Chemistry", "Animal Sciences", "Aquatic Sciences", "Biology",
        "Biotechnology & Applied Microbiology", "Entomology/Pest Control", "Environment/Ecology",
        "Food Science/Nutrition", "Multidisciplinary", "Plant Sciences", "Veterinary Medicine/Animal Health",
    ],
    "Arts & Humanities": [
        "Archaeology", "Art & Architecture", "Classical Studies", "General", "History",
        "Language & Linguistics", "Literature", "Performing Arts", "Philosophy", "Religion & Theology",
    ],
    "Business & Economics": [
        "Accounting & Finance", "Business & Economics", "Business Law & Reviews",
        "Computer Technology & Information Systems", "Employee Relations & Human Resources",
        "Management & Organization", "Marketing & Business Communication", "Political Science",
        "Public Administration & Development",
    ],
    "Clinical Medicine": [
        "Anesthesia & Intensive Care", "Cardiovascular & Respiratory Systems",
        "Clinical Immunology & Infectious Disease", "Clinical Psychology & Psychiatry",
        "Dentistry/Oral Surgery & Medicine", "Dermatology", "Endocrinology, Metabolism & Nutrition",
        "Environmental Medicine & Public Health", "Gastroenterology & Hepatology",
        "General & Internal Medicine", "Health Care Sciences & Services", "Hematology", "Neurology", "Nursing",
        "Oncology", "Ophthalmology", "Orthopedics, Rehabilitation & Sports Medicine", "Otolaryngology",
        "Pediatrics", "Pharmacology/Toxicology", "Radiology, Nuclear Medicine & Imaging",
        "Reproductive Medicine", "Research/Laboratory Medicine & Medical Technology", "Rheumatology",
        "Surgery, Urology & Nephrology",
    ],
    "Electronics & Telecommunications": [
        "Applied Physics", "Computer Science", "Electronics & Electrical Engineering",
        "Optics & Laser Research", "Semiconductors & Solid State Materials",
        "Signal Processing/Circuits & Systems", "Telecommunications Technology", "Technology R&D/Management",
    ],
    "Engineering, Computing & Technology": [
        "Aerospace Engineering", "Artificial Intelligence", "Deep Learning", "Machine Learning",
        "Natural Language Processing", "Robotics & Automatic Control", "Chemical Engineering",
        "Civil Engineering", "Computer Science & Engineering", "Electrical & Electronics Engineering",
        "Engineering Management/General", "Engineering Mathematics", "Environmental Engineering & Energy",
        "Geological, Petroleum, & Mining Engineering", "Information Technology & Communication Systems",
        "Instrumentation & Measurement", "Materials Science & Engineering", "Mechanical Engineering",
        "Metallurgy", "Nuclear Engineering", "Optics & Acoustics",
    ],
    "Life Sciences": [
        "Animal & Plant Sciences", "Biochemistry & Biophysics", "Cardiovascular & Hematology Research",
        "Cell & Developmental Biology", "Chemistry & Analysis", "Endocrinology, Nutrition & Metabolism",
        "Experimental Biology", "Immunology", "Medical Research, Diagnosis & Treatment",
        "Medical Research, General Topics", "Medical Research, Organs & Systems",
        "Microbiology, Molecular Biology & Genetics", "Neurosciences & Behavior",
        "Oncogenesis & Cancer Research", "Pharmacology & Toxicology", "Physiology",
    ],
    "Physical, Chemical & Earth Sciences": [
        "Applied Physics/Condensed Matter/Materials Science", "Chemistry", "Earth Sciences",
        "Inorganic & Nuclear Chemistry", "Mathematics, Multidisciplinary",
        "Organic Chemistry/Polymer Science", "Physical Chemistry/Chemical Physics", "Physics, Space Science",
        "Spectroscopy/Instrumentation/Analytical Sciences",
    ],
    "Social & Behavioral Sciences": [
        "Anthropology", "Communication", "Economics", "Education", "Environmental Studies",
        "Geography & Development", "Law", "Library & Information Sciences", "Management",
        "Political Science & Public Administration", "Psychiatry", "Psychology",
        "Public Health & Health Care Science", "Rehabilitation, Social Work & Social Policy",
        "Sociology & Social Sciences",
    ],
}


def anchors_df(spark: SparkSession, taxonomy: Mapping[str, Sequence[str]] = DISCIPLINES) -> DataFrame:
    """``(ordinal, discipline, subfields, text)``; the text joins the sub-fields with ``", "``."""
    rows = [(i, name, list(fields)) for i, (name, fields) in enumerate(taxonomy.items())]
    return spark.createDataFrame(
        rows, "ordinal int, discipline string, subfields array<string>"
    ).withColumn("text", F.concat_ws(", ", "subfields"))
