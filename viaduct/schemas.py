"""Schemas, contract columns, domains and code tables."""

from __future__ import annotations

# Columns of the contract files in their order, and the values that they may hold.
FILE_1 = ["total_proposed_stations", "total_existing_stations_baseline", "total_friction_points", "total_ev_projected_2027"]
FILE_2 = ["location_id", "latitude", "longitude", "route_segment", "n_chargers_proposed", "grid_status"]
FILE_3 = ["bottleneck_id", "latitude", "longitude", "route_segment", "distributor_network", "estimated_demand_kw", "grid_status"]
STATUSES = ["Sufficient", "Moderate", "Congested"]
FRICTION = ["Moderate", "Congested"]
DISTRIBUTORS = ["i-DE", "Endesa", "Viesgo"]

GRID_NODE = "substation_name string, provincia string, municipio string, utm_x double, utm_y double, available_capacity_mw double, voltage_kv double, distributor_network string"
REGISTRATION = "FEC_MATRICULA string, MARCA_ITV string, MODELO_ITV string, COD_TIPO string, COD_PROPULSION_ITV string, `CATEGORÍA_VEHÍCULO_ELÉCTRICO` string, CLAVE_TRAMITE string"
EV_MONTHLY = "year_month string, ev_registrations bigint, date date"
TOURISM = "province_code string, province_name string, month_name string, month_number int, occupancy_rate_pct double, annual_occupancy_rate_pct double, seasonal_multiplier double"
POPULATION = "cpro string, provincia string, cmun string, nombre string, pob_2025 bigint, hombres bigint, mujeres bigint, municipality_code string"
ACCIDENT = "ANYO int, MES int, DIA_SEMANA int, HORA int, TOTAL_VICTIMAS_24H int, TIPO_ACCIDENTE double, TITULARIDAD_VIA double, TIPO_VIA double, COD_MUNICIPIO string"
FEATURE = "type string, id string, geometry struct<type:string,coordinates:string>, properties map<string,string>"

# Propulsion codes of vehicle registrations.
PROPULSION = {
    "0": "Gasolina", "1": "Diesel", "2": "Eléctrico", "3": "Otros", "4": "Butano", "5": "Solar", "6": "Gas Licuado de Petróleo",
    "7": "Gas Natural Comprimido", "8": "Gas Natural Licuado", "9": "Hidrógeno", "A": "Biometano", "B": "Etanol", "C": "Biodiesel",
}

# Names of the provinces by their statistical code.
PROVINCES = {
    1: "Araba/Álava", 2: "Albacete", 3: "Alicante/Alacant", 4: "Almería", 5: "Ávila", 6: "Badajoz", 7: "Balears, Illes", 8: "Barcelona", 9: "Burgos", 10: "Cáceres",
    11: "Cádiz", 12: "Castellón/Castelló", 13: "Ciudad Real", 14: "Córdoba", 15: "Coruña, A", 16: "Cuenca", 17: "Girona", 18: "Granada", 19: "Guadalajara", 20: "Gipuzkoa",
    21: "Huelva", 22: "Huesca", 23: "Jaén", 24: "León", 25: "Lleida", 26: "Rioja, La", 27: "Lugo", 28: "Madrid", 29: "Málaga", 30: "Murcia",
    31: "Navarra", 32: "Ourense", 33: "Asturias", 34: "Palencia", 35: "Palmas, Las", 36: "Pontevedra", 37: "Salamanca", 38: "Santa Cruz de Tenerife", 39: "Cantabria", 40: "Segovia",
    41: "Sevilla", 42: "Soria", 43: "Tarragona", 44: "Teruel", 45: "Toledo", 46: "Valencia/València", 47: "Valladolid", 48: "Bizkaia", 49: "Zamora", 50: "Zaragoza",
    51: "Ceuta", 52: "Melilla",
}
