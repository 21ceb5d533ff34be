"""Table layouts of the listing store, as DDL; unknown facts of a source go to raw_fields."""

LISTING = (
    "id long, source string, external_id string, country string, url string, type string, place string, region string, dept_nl string, dept_fr string, "
    "lat double, lon double, price long, currency string, old_price long, rooms int, bedrooms int, baths int, living_m2 int, land_m2 int, year_built int, "
    "energy_label string, gas_label string, energy_kwh int, gas_co2 int, reference string, agent string, agent_name string, agent_address string, snippet string, "
    "description string, features string, thumb string, photos array<string>, raw_fields string, promoted boolean, first_seen timestamp_ntz, last_seen timestamp_ntz, "
    "detail_fetched timestamp_ntz, gone_at timestamp_ntz"
)
HISTORY = "id long, listing_id long, seen_at timestamp_ntz, price long"
BRIDGE = "listing_id long, search string, last_seen timestamp_ntz"
RUNS = "id long, search string, started_at timestamp_ntz, finished_at timestamp_ntz, pages long, seen long, new long, price_drops long, price_rises long, gone long"
SEARCH = "source string, label string, note string, path string, enabled boolean, skip struct<priceless:boolean,above:long,below:long>, bands array<array<long>>"

DEFAULT_SOURCE, DEFAULT_CURRENCY = "franimo", "EUR"
# Which columns a card and which a detail page may write.
CARD_COLUMNS = ["url", "type", "place", "region", "dept_nl", "lat", "lon", "price", "old_price", "bedrooms", "baths", "living_m2", "land_m2", "reference", "thumb", "snippet"]
DETAIL_COLUMNS = [
    "url", "type", "place", "region", "dept_nl", "dept_fr", "lat", "lon", "price", "rooms", "bedrooms", "baths", "living_m2", "land_m2", "year_built", "energy_label", "gas_label",
    "energy_kwh", "gas_co2", "reference", "agent", "agent_name", "agent_address", "description", "features", "photos", "raw_fields", "currency",
]
