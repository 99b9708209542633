"""Country codes and map positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.affiliations import normalize_country

# ISO 3166 codes of country names.
ISO3 = {
    "Afghanistan": "AFG", "Albania": "ALB", "Algeria": "DZA", "Andorra": "AND", "Angola": "AGO", "Antigua and Barbuda": "ATG", "Argentina": "ARG",
    "Armenia": "ARM", "Australia": "AUS", "Austria": "AUT", "Azerbaijan": "AZE", "Bahamas": "BHS", "Bahrain": "BHR", "Bangladesh": "BGD",
    "Barbados": "BRB", "Belarus": "BLR", "Belgium": "BEL", "Belize": "BLZ", "Benin": "BEN", "Bhutan": "BTN", "Bolivia": "BOL",
    "Bosnia and Herzegovina": "BIH", "Botswana": "BWA", "Brazil": "BRA", "Brunei": "BRN", "Bulgaria": "BGR", "Burkina Faso": "BFA", "Burundi": "BDI",
    "Cabo Verde": "CPV", "Cambodia": "KHM", "Cameroon": "CMR", "Canada": "CAN", "Central African Republic": "CAF", "Chad": "TCD", "Chile": "CHL",
    "China": "CHN", "Colombia": "COL", "Comoros": "COM", "Congo": "COG", "Costa Rica": "CRI", "Croatia": "HRV", "Cuba": "CUB", "Cyprus": "CYP",
    "Czech Republic": "CZE", "Denmark": "DNK", "Djibouti": "DJI", "Dominica": "DMA", "Dominican Republic": "DOM", "Ecuador": "ECU", "Egypt": "EGY",
    "El Salvador": "SLV", "Equatorial Guinea": "GNQ", "Eritrea": "ERI", "Estonia": "EST", "Eswatini": "SWZ", "Ethiopia": "ETH", "Fiji": "FJI",
    "Finland": "FIN", "France": "FRA", "Gabon": "GAB", "Gambia": "GMB", "Georgia": "GEO", "Germany": "DEU", "Ghana": "GHA", "Greece": "GRC",
    "Grenada": "GRD", "Guatemala": "GTM", "Guinea": "GIN", "Guinea-Bissau": "GNB", "Guyana": "GUY", "Haiti": "HTI", "Honduras": "HND",
    "Hungary": "HUN", "Iceland": "ISL", "India": "IND", "Indonesia": "IDN", "Iran": "IRN", "Iraq": "IRQ", "Ireland": "IRL", "Israel": "ISR",
    "Italy": "ITA", "Jamaica": "JAM", "Japan": "JPN", "Jordan": "JOR", "Kazakhstan": "KAZ", "Kenya": "KEN", "Kiribati": "KIR", "Kuwait": "KWT",
    "Kyrgyzstan": "KGZ", "Laos": "LAO", "Latvia": "LVA", "Lebanon": "LBN", "Lesotho": "LSO", "Liberia": "LBR", "Libya": "LBY", "Liechtenstein": "LIE",
    "Lithuania": "LTU", "Luxembourg": "LUX", "Madagascar": "MDG", "Malawi": "MWI", "Malaysia": "MYS", "Maldives": "MDV", "Mali": "MLI",
    "Malta": "MLT", "Marshall Islands": "MHL", "Mauritania": "MRT", "Mauritius": "MUS", "Mexico": "MEX", "Micronesia": "FSM", "Moldova": "MDA",
    "Monaco": "MCO", "Mongolia": "MNG", "Montenegro": "MNE", "Morocco": "MAR", "Mozambique": "MOZ", "Myanmar": "MMR", "Namibia": "NAM",
    "Nepal": "NPL", "Netherlands": "NLD", "New Zealand": "NZL", "Nicaragua": "NIC", "Niger": "NER", "Nigeria": "NGA", "North Macedonia": "MKD",
    "Norway": "NOR", "Oman": "OMN", "Pakistan": "PAK", "Palau": "PLW", "Panama": "PAN", "Papua New Guinea": "PNG", "Paraguay": "PRY", "Peru": "PER",
    "Philippines": "PHL", "Poland": "POL", "Portugal": "PRT", "Qatar": "QAT", "Romania": "ROU", "Russia": "RUS", "Rwanda": "RWA",
    "Saint Kitts and Nevis": "KNA", "Saint Lucia": "LCA", "Saint Vincent and the Grenadines": "VCT", "Samoa": "WSM", "San Marino": "SMR",
    "Sao Tome and Principe": "STP", "Saudi Arabia": "SAU", "Senegal": "SEN", "Serbia": "SRB", "Seychelles": "SYC", "Sierra Leone": "SLE",
    "Singapore": "SGP", "Slovakia": "SVK", "Slovenia": "SVN", "Solomon Islands": "SLB", "Somalia": "SOM", "South Africa": "ZAF", "South Korea": "KOR",
    "South Sudan": "SSD", "Spain": "ESP", "Sri Lanka": "LKA", "Sudan": "SDN", "Suriname": "SUR", "Sweden": "SWE", "Switzerland": "CHE",
    "Syria": "SYR", "Taiwan": "TWN", "Tajikistan": "TJK", "Tanzania": "TZA", "Thailand": "THA", "Timor-Leste": "TLS", "Togo": "TGO", "Tonga": "TON",
    "Trinidad and Tobago": "TTO", "Tunisia": "TUN", "Turkey": "TUR", "Turkmenistan": "TKM", "Tuvalu": "TUV", "Uganda": "UGA", "Ukraine": "UKR",
    "United Arab Emirates": "ARE", "United Kingdom": "GBR", "United States": "USA", "Uruguay": "URY", "Uzbekistan": "UZB", "Vanuatu": "VUT",
    "Venezuela": "VEN", "Vietnam": "VNM", "Yemen": "YEM", "Zambia": "ZMB", "Zimbabwe": "ZWE",
}
# Latitude and longitude of countries by code.
POSITIONS = {
    "AFG": (33.9391, 67.71), "ALB": (41.1533, 20.1683), "DZA": (28.0339, 1.6596), "AND": (42.5063, 1.5218), "AGO": (-11.2027, 17.8739),
    "ATG": (17.0608, -61.7964), "ARG": (-38.4161, -63.6167), "ARM": (40.0691, 45.0382), "AUS": (-25.2744, 133.7751), "AUT": (47.5162, 14.5501),
    "AZE": (40.1431, 47.5769), "BHS": (25.0343, -77.3963), "BHR": (25.9304, 50.6378), "BGD": (23.685, 90.3563), "BRB": (13.1939, -59.5432),
    "BLR": (53.7098, 27.9534), "BEL": (50.8503, 4.3517), "BLZ": (17.1899, -88.4976), "BEN": (9.3077, 2.3158), "BTN": (27.5142, 90.4336),
    "BOL": (-16.2902, -63.5887), "BIH": (43.9159, 17.6791), "BWA": (-22.3285, 24.6849), "BRA": (-14.235, -51.9253), "BRN": (4.5353, 114.7277),
    "BGR": (42.7339, 25.4858), "BFA": (12.2383, -1.5616), "BDI": (-3.3731, 29.9189), "CPV": (16.002, -24.0132), "KHM": (12.5657, 104.991),
    "CMR": (7.3697, 12.3547), "CAN": (56.1304, -106.3468), "CAF": (6.6111, 20.9394), "TCD": (15.4542, 18.7322), "CHL": (-35.6751, -71.543),
    "CHN": (35.8617, 104.1954), "COL": (4.5709, -74.2973), "COM": (-11.6455, 43.3333), "COG": (-0.228, 15.8277), "CRI": (9.7489, -83.7534),
    "HRV": (45.1, 15.2), "CUB": (21.5218, -77.7812), "CYP": (35.1264, 33.4299), "CZE": (49.8175, 15.473), "DNK": (56.2639, 9.5018),
    "DJI": (11.8251, 42.5903), "DMA": (15.415, -61.371), "DOM": (18.7357, -70.1627), "ECU": (-1.8312, -78.1834), "EGY": (26.8206, 30.8025),
    "SLV": (13.7942, -88.8965), "GNQ": (1.6508, 10.2679), "ERI": (15.1794, 39.7823), "EST": (58.5953, 25.0136), "SWZ": (-26.5225, 31.4659),
    "ETH": (9.145, 40.4897), "FJI": (-16.5782, 179.4145), "FIN": (61.9241, 25.7482), "FRA": (46.2276, 2.2137), "GAB": (-0.8037, 11.6094),
    "GMB": (13.4432, -15.3101), "GEO": (42.3154, 43.3569), "DEU": (51.1657, 10.4515), "GHA": (7.9465, -1.0232), "GRC": (39.0742, 21.8243),
    "GRD": (12.1165, -61.6793), "GTM": (15.7835, -90.2308), "GIN": (9.9456, -9.6966), "GNB": (11.8037, -15.1804), "GUY": (4.8604, -58.9302),
    "HTI": (18.9712, -72.2852), "HND": (15.2, -86.2419), "HUN": (47.1625, 19.5033), "ISL": (64.9631, -19.0208), "IND": (20.5937, 78.9629),
    "IDN": (-0.7893, 113.9213), "IRN": (32.4279, 53.688), "IRQ": (33.2232, 43.6793), "IRL": (53.1424, -7.6921), "ISR": (31.0461, 34.8516),
    "ITA": (41.8719, 12.5674), "JAM": (18.1096, -77.2975), "JPN": (36.2048, 138.2529), "JOR": (30.5852, 36.2384), "KAZ": (48.0196, 66.9237),
    "KEN": (-0.0236, 37.9062), "KIR": (1.352, 173.0189), "KWT": (29.3117, 47.481), "KGZ": (41.2044, 74.7661), "LAO": (19.8563, 102.4955),
    "LVA": (56.8796, 24.6032), "LBN": (33.8547, 35.8623), "LSO": (-29.61, 28.2336), "LBR": (6.4281, -9.4295), "LBY": (26.3351, 17.2283),
    "LIE": (47.166, 9.5554), "LTU": (55.1694, 23.8813), "LUX": (49.8153, 6.1296), "MDG": (-18.7669, 46.8691), "MWI": (-13.2543, 34.3015),
    "MYS": (4.2105, 101.9758), "MDV": (3.2028, 73.2207), "MLI": (17.5707, -3.9962), "MLT": (35.9375, 14.3754), "MHL": (7.1095, 171.1845),
    "MRT": (21.0079, -10.9407), "MUS": (-20.3484, 57.5522), "MEX": (23.6345, -102.5528), "FSM": (7.4256, 150.5508), "MDA": (47.4116, 28.3699),
    "MCO": (43.7384, 7.4246), "MNG": (46.8625, 103.8467), "MNE": (42.7087, 19.3744), "MAR": (31.6295, -7.0926), "MOZ": (-18.6657, 35.5296),
    "MMR": (21.9162, 95.956), "NAM": (-22.9576, 18.4904), "NPL": (28.3949, 84.124), "NLD": (52.1326, 5.2913), "NZL": (-40.9006, 174.886),
    "NIC": (12.8654, -85.2072), "NER": (17.6078, 8.0817), "NGA": (9.082, 8.6753), "MKD": (41.6086, 21.7453), "NOR": (60.472, 6.5631),
    "OMN": (21.5126, 55.9233), "PAK": (30.3753, 69.3451), "PLW": (7.515, 134.5825), "PAN": (8.538, -80.7821), "PNG": (-6.315, 143.9555),
    "PRY": (-23.4426, -58.4438), "PER": (-9.19, -75.0152), "PHL": (12.8797, 121.774), "POL": (51.9194, 19.1451), "PRT": (39.3999, -8.2245),
    "QAT": (25.3548, 51.1839), "ROU": (45.9432, 24.9668), "RUS": (61.524, 105.3188), "RWA": (-1.9403, 29.8739), "KNA": (17.3578, -62.783),
    "LCA": (13.9094, -60.9789), "VCT": (13.2526, -61.1971), "WSM": (-13.759, -172.1046), "SMR": (43.9333, 12.4464), "STP": (0.1864, 6.6131),
    "SAU": (23.8859, 45.0792), "SEN": (14.4974, -14.4524), "SRB": (44.0168, 21.0059), "SYC": (-4.6796, 55.492), "SLE": (8.4606, -11.7799),
    "SGP": (1.3521, 103.8198), "SVK": (48.669, 19.699), "SVN": (46.1512, 14.9955), "SLB": (-9.6457, 160.1562), "SOM": (5.1521, 46.1996),
    "ZAF": (-30.5595, 22.9375), "KOR": (35.9078, 127.7669), "SSD": (6.8769, 31.3067), "ESP": (40.4637, -3.7492), "LKA": (7.8731, 80.7718),
    "SDN": (12.8628, 30.2177), "SUR": (3.9193, -56.0278), "SWE": (60.1282, 18.6435), "CHE": (46.8182, 8.2275), "SYR": (34.8021, 38.9968),
    "TWN": (23.6978, 120.9605), "TJK": (38.861, 71.2761), "TZA": (-6.369, 34.8888), "THA": (15.87, 100.9925), "TLS": (-8.8742, 125.7279),
    "TGO": (8.6195, 0.8248), "TON": (-21.1781, -175.1982), "TTO": (10.6918, -61.2225), "TUN": (33.8869, 9.5375), "TUR": (38.9637, 35.2433),
    "TKM": (38.9697, 59.5563), "TUV": (-7.1095, 177.6493), "UGA": (1.3733, 32.2903), "UKR": (48.3794, 31.1656), "ARE": (23.4241, 53.8478),
    "GBR": (55.3781, -3.436), "USA": (37.0902, -95.7129), "URY": (-32.5228, -55.7658), "UZB": (41.3775, 64.5853), "VUT": (-15.3767, 166.9592),
    "VEN": (6.4238, -66.5897), "VNM": (14.0583, 108.2772), "YEM": (15.5527, 48.5164), "ZMB": (-13.1339, 27.8493), "ZWE": (-19.0154, 29.1549),
}


def iso3(country: Column) -> Column:
    """The code of a country in any known writing; null if it has none."""
    name = F.coalesce(normalize_country(country, compat=False), F.initcap(F.trim(country)))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv]), name)


def with_positions(df: DataFrame, code: str = "iso3") -> DataFrame:
    """``df`` with lat and lng of the code, null where unknown."""
    spots = df.sparkSession.createDataFrame([(k, *v) for k, v in POSITIONS.items()], f"{code} string, lat double, lng double")
    return df.join(F.broadcast(spots), code, "left")  # one row per country
