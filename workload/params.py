"""Fixed arguments of the keyed queries."""

REF = "2000-07-01"
LOAD_PERIOD = "2000-08-01"
# Months that are loaded together: one of the history, and one behind its end.
LOAD_PERIODS = ("2000-08-01", "2030-01-01")
SOURCE_FILE = "registro.txt"
MODEL = "HARLEY DAVIDSON/129 XL1200X"
SOME_MODELS = ("HARLEY DAVIDSON/144 FLHX", "HARLEY DAVIDSON/44 XR1200X", "H.DAVIDSON/7 RA1250S")
START, END = "1999-11-01", "2000-07-01"
PENDING_YEAR = 2000
YEARS = (1998, 1999)
PATTERN = "%FLHX%"
TERM = "flhx"
STATE, CITY = "NATION_15", " Sem Informação "
SOME_STATES = ("NATION_1", "NATION_15", "NATION_7")
SOME_CITIES = (" Sem Informação ", "Supplier#000000001")
# So late that no model year of the tables is recent.
LATE = "2040-01-01"
MONTHS_BACK = 24
BRAND_MODELS = ("INDIAN/SCOUT", "I/INDIAN CHIEF VINTAGE", "I/INDIAN CHIEF DARKHORSE", "IMP/INDIAN")
# Months that came late or were corrected after the table of pairs was built: the first, one by itself, two neighbours, the last.
LATE_LOADS = {
    "1995-01-01": "wrong",
    "1998-12-01": "missing",
    "2000-07-01": "missing",
    "2000-08-01": "wrong",
    "2001-11-01": "missing",
}
