"""Schemas and fixed values of trip tracking."""

# Fixed values.
EARTH_RADIUS_M = 6371008.8
ACTIVITIES = ("still", "walking", "on_foot", "running", "on_bicycle", "in_vehicle", "shaking", "unknown")
ACTIVITY_MAX_SPEED = {"still": 0.5, "walking": 2.5, "on_foot": 2.5, "running": 12.0, "on_bicycle": 25.0, "in_vehicle": 50.0, "shaking": 1.0, "unknown": 50.0}
MAX_SPEED, MAX_ACCELERATION, MAX_ACCURACY = 100.0, 15.0, 100.0
MIN_UPDATE_INTERVAL, MAX_NORMAL_GAP, MAX_ACCEPTABLE_GAP, MIN_STOP_SECONDS = 0.5, 30.0, 300.0, 60.0
CONFIDENCE_WEIGHTS = {"gps": 0.25, "speed": 0.20, "acceleration": 0.15, "temporal": 0.15, "activity": 0.15, "continuity": 0.10}
FLAG_PENALTIES = {
    "invalid_coordinates": 0.5, "teleportation": 0.4, "timestamp_out_of_order": 0.3, "unrealistic_speed": 0.15, "unrealistic_acceleration": 0.1, "gps_drift": 0.1,
    "low_gps_accuracy": 0.05, "duplicate_timestamp": 0.05, "large_time_gap": 0.05, "missing_speed": 0.02, "missing_accuracy": 0.02,
}
MAX_PENALTY = 0.8
MATURE_TRIPS, MATURE_POINTS = 5, 100

RAW_EVENT = """
user_id bigint, trip_index_for_user int, trip_global_index bigint, point_index int, trip_title string, trip_session string,
trip_start timestamp, trip_end timestamp, trip_duration_minutes double, trip_distance_km double, timestamp timestamp,
lat double, lon double, speed double, is_moving int, activity_type string, activity_confidence int, coords_accuracy double,
odometer double, live_address string
"""
