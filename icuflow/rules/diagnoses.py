"""Diagnosis code ranges, chapters and mortality-rate bins."""

# --- fixed values: comorbidity code ranges (byte order, blanks are significant) ---------
AIDS_RANGES = (("042  ", "0449 "),)
HEM_RANGES = (
    ("20000", "20238"), ("20240", "20248"), ("20250", "20302"), ("20310", "20312"), ("20302", "20382"),
    ("20400", "20522"), ("20580", "20702"), ("20720", "20892"), ("2386 ", "2386 "), ("2733 ", "2733 "),
)
METS_RANGES = (("1960 ", "1991 "), ("20970", "20975"), ("20979", "20979"), ("78951", "78951"))

# --- fixed values: chapters, open intervals of the three-digit code ------------------------
CHAPTERS = (
    (1, 139, "Infectious And Parasitic Diseases"),
    (140, 239, "Neoplasms"),
    (240, 279, "Endocrine, Nutritional And Metabolic Diseases, And Immunity Disorders"),
    (280, 289, "Diseases Of The Blood And Blood-Forming Organs"),
    (290, 319, "Mental Disorders"),
    (320, 389, "Diseases Of The Nervous System And Sense Organs"),
    (390, 459, "Diseases Of The Circulatory System"),
    (460, 519, "Diseases Of The Respiratory System"),
    (520, 579, "Diseases Of The Digestive System"),
    (580, 629, "Diseases Of The Genitourinary System"),
    (630, 679, "Complications Of Pregnancy, Childbirth, And The Puerperium"),
    (680, 709, "Diseases Of The Skin And Subcutaneous Tissue"),
    (710, 739, "Diseases Of The Musculoskeletal System And Connective Tissue"),
    (740, 759, "Congenital Anomalies"),
    (760, 779, "Certain Conditions Originating In The Perinatal Period"),
    (780, 799, "Symptoms, Signs, And Ill-Defined Conditions"),
    (800, 999, "Injury And Poisoning"),
)
OTHER_CHAPTER = "Other"

# --- fixed values: mortality-rate bins -------------------------------------------------------
SINGLE_BINS = ((0.7, 2), (0.5, 1))     # rate at least -> bin, otherwise 0
PAIR_BINS = ((0.9, 2), (0.5, 1))       # rate at least -> bin, otherwise none
LIFT = 0.25
MIN_DEATHS, MIN_PAIRS, TOP_DIAGNOSES = 10, 10, 50

# --- fixed values: age bands ------------------------------------------------------------------
AGE_BANDS = ((1, "neonate"), (14, "1-14"), (39, "15-39"), (64, "40-64"), (89, "65-89"))
AGE_BAND_ABOVE = ">89"
OASIS_AGE_BANDS = ((1, "neonate"), (15, "middle"))
OASIS_AGE_ABOVE = "adult"
DAYS_PER_YEAR = 365.242
