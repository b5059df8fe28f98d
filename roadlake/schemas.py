"""Explicit schemas of the telemetry tables, messages and files."""

from __future__ import annotations

from pyspark.sql import types as T

PIDS = ["speed_kmh", "rpm", "throttle_pct", "coolant_temp_c", "engine_load_pct"]
ACCELS = ["accel_x", "accel_y", "accel_z"]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


_D, _S, _L, _TS = T.DoubleType(), T.StringType(), T.LongType(), T.TimestampType()

PID_READING = _struct(("value", _D), ("unit", _S), ("desc", _S))
OBD_MESSAGE = _struct(
    ("ts", _D), ("mode", _S), *[(c, _D) for c in PIDS], ("all_pids", T.MapType(_S, PID_READING))
)
IMU_MESSAGE = _struct(("ts", _D), *[(c, _D) for c in ACCELS])
ANY_MESSAGE = T.StructType(OBD_MESSAGE.fields + IMU_MESSAGE.fields[1:] + [T.StructField("_corrupt", _S, True)])
# The two topics.
TOPIC_OBD = "telemetry/vehicle/obd"
TOPIC_IMU = "telemetry/vehicle/imu"

# Header text of a trip file -> our column name, in file order.
TRIP_HEADER = {
    "Time": "time_str",
    "Engine Coolant Temperature [°C]": "coolant_temp_c",
    "Intake Manifold Absolute Pressure [kPa]": "map_kpa",
    "Engine RPM [RPM]": "rpm",
    "Vehicle Speed Sensor [km/h]": "speed_kmh",
    "Intake Air Temperature [°C]": "intake_air_temp_c",
    "Air Flow Rate from Mass Flow Sensor [g/s]": "maf_gs",
    "Absolute Throttle Position [%]": "throttle_pct",
    "Ambient Air Temperature [°C]": "ambient_temp_c",
    "Accelerator Pedal Position D [%]": "pedal_d_pct",
    "Accelerator Pedal Position E [%]": "pedal_e_pct",
}

# Condition label in a trip file name -> our label.
TRIP_CONDITIONS = {
    "Normal": "normal",
    "Frei": "free_flow",
    "Stau": "traffic_jam",
    "Vollbremsung": "hard_braking",
    "Glatteis": "black_ice",
    "Beschleunigung": "acceleration_test",
    "Messfehler": "measurement_error",
}
NORMAL_CONDITIONS = ["normal", "free_flow", "traffic_jam"]

# Weekly file header -> our column name.
WEEKLY_HEADER = {
    "VehId": "vehicle_id",
    "Trip": "trip",
    "DayNum": "day_num",
    "Timestamp(ms)": "offset_ms",
    "Vehicle Speed[km/h]": "speed_kmh",
    "Engine RPM[RPM]": "rpm",
    "Absolute Load[%]": "engine_load_pct",
}

SWEEP_RESULTS = _struct(
    ("std_multiple", _D), ("magnitude", _D), ("n_windows", _L),
    ("detect_rate_at_2pct_fpr", _D), ("detect_rate_at_5pct_fpr", _D), ("detect_rate_at_10pct_fpr", _D),
    ("vehicle_id", _L), ("powertrain", _S), ("day_cutoff", _S), ("n_train_trips", _L),
    ("n_train_rows", _L), ("actual_train_span_days", _D), ("fault_type", _S),
)
