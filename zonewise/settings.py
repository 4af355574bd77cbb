"""Defaults of the study area. Every operator takes these as arguments, so another area is a parameter away."""

# Names, box, radii, bounds and weights decide the results and are stated as given.
MUNICIPALITIES = [
    "Tel Aviv-Yafo",
    "Ramat Gan",
    "Givatayim",
    "Bnei Brak",
    "Holon",
    "Bat Yam",
    "Petah Tikva",
    "Rishon LeZion",
    "Herzliya",
    "Ramat HaSharon",
    "Kiryat Ono",
    "Givat Shmuel",
]
BBOX = (34.70, 31.90, 34.95, 32.20)  # min lon, min lat, max lon, max lat
COUNTRY_BOUNDS = (30.0, 28.0, 40.0, 34.0)
TRANSIT_RADIUS_M = 500.0
WIDE_TRANSIT_RADIUS_M = 1000.0
PARK_RADIUS_M = 1000.0
MIN_TRANSACTIONS = 3
PRICE_MIN = 200_000.0
PRICE_MAX = 100_000_000.0
WEIGHTS = {"affordability": 0.40, "transit": 0.35, "parks": 0.25}
SCENARIOS = {
    "Default (40/35/25)": (0.40, 0.35, 0.25),
    "Price-focused (70/15/15)": (0.70, 0.15, 0.15),
    "Transit-focused (20/60/20)": (0.20, 0.60, 0.20),
    "Green-focused (20/20/60)": (0.20, 0.20, 0.60),
}
DEFAULT_BUDGET = 10_000_000.0
STORAGE_CRS = "EPSG:4326"
METRIC_CRS = "EPSG:2039"
