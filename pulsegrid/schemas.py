"""Fixed schemas. A record is always a string and missing is always NULL."""

from pyspark.sql import types as T

# Header fields as written in the files (lower-case) and the columns they become.
HEADER_FIELDS = {
    "ph": "pH", "bdecf": "BDecf", "pco2": "pCO2", "be": "BE", "apgar1": "Apgar1", "apgar5": "Apgar5",
    "nicu days": "NICU_days", "seizures": "Seizures", "hie": "HIE", "intubation": "Intubation", "main diag.": "Main_diag", "other diag.": "Other_diag",
    "gest. weeks": "Gest_weeks", "weight(g)": "Weight_g", "sex": "Sex",
    "age": "Age", "gravidity": "Gravidity", "parity": "Parity", "diabetes": "Diabetes", "hypertension": "Hypertension", "preeclampsia": "Preeclampsia",
    "liq. praecox": "Liq_praecox", "pyrexia": "Pyrexia", "meconium": "Meconium",
    "presentation": "Presentation", "induced": "Induced", "i.stage": "I_stage", "noprogress": "NoProgress", "ck/kp": "CK_KP", "ii.stage": "II_stage", "deliv. type": "Deliv_type",
    "dbid": "dbID", "rec. type": "Rec_type", "pos. ii.st.": "Pos_IIst", "sig2birth": "Sig2Birth",
}

TEXT_FIELDS = ("Main_diag", "Other_diag")

CLINICAL = T.StructType([T.StructField("record", T.StringType(), False), *[T.StructField(c, T.StringType() if c in TEXT_FIELDS else T.DoubleType()) for c in HEADER_FIELDS.values()]])

SIGNALS = T.StructType([T.StructField("record", T.StringType(), False), T.StructField("fhr", T.ArrayType(T.DoubleType())), T.StructField("uc", T.ArrayType(T.DoubleType())), T.StructField("fs", T.IntegerType())])

# Which columns may predict, and which never may.
BASELINE = ("Age", "Gravidity", "Parity", "Diabetes", "Pyrexia", "Gest_weeks", "Sex")
#: Trend columns by kind, and the feature that each follows.
DELTAS = {"delta_baseline_std_bpm": "fhr_baseline_std_bpm", "delta_sampen": "fhr_sampen"}
STREAKS = {"fhr_std_falling_streak": "fhr_baseline_std_bpm", "fhr_sampen_falling_streak": "fhr_sampen"}
SLOPES = {"slope_sampen_30min": "fhr_sampen", "slope_baseline_mean_30min": "fhr_baseline_mean_bpm"}
TRENDS = (*DELTAS, *STREAKS, *SLOPES)
# Presentation, Induced and CK_KP are known at birth only, so they are kept out too.
PROHIBITED = ("pH", "BDecf", "pCO2", "BE", "Apgar1", "Apgar5", "NICU_days", "Seizures", "HIE", "Intubation", "Main_diag", "Other_diag", "Presentation", "Induced", "I_stage", "NoProgress", "CK_KP", "II_stage", "Deliv_type", "dbID", "Rec_type", "Pos_IIst", "Sig2Birth", "Weight_g")
