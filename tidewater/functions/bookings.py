"""Appointment requests as people write them: whom to see, on which day, at what time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Who can be booked, under which words, and when.
DOCTORS = (
    ("Dr. Ahmed", "General Physician", ("ahmed", "ahmad", "general physician", "general", "gp", "physician", "checkup", "check up")),
    ("Dr. Sara", "Dermatologist", ("sara", "sarah", "dermatologist", "dermatology", "skin doctor", "skin")),
    ("Dr. Ali", "Cardiologist", ("ali", "cardiologist", "cardiology", "heart doctor", "heart")),
)
OPENS, CLOSES = 9, 19
TIME = r"([0-9]{1,2})\s*[:.]?\s*([0-9]{2})?\s*(am|pm)?"
#: Days counted from today, by the words for them.
NEAR_DAYS = (("today", 0), ("tomorrow", 1), ("day after tomorrow", 2))
#: Other ways to write a date.
FORMATS = ("yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy")


def doctor(said: Column) -> Column:
    """struct(name, specialty) of the first doctor one of whose words is said; else null."""
    t = F.lower(said)
    return F.coalesce(*[F.when(t.rlike("|".join(words)), F.struct(F.lit(name).alias("name"), F.lit(what).alias("specialty"))) for name, what, words in DOCTORS])


def day(said: Column, today: Column) -> Column:
    """The date meant, else null."""
    t = F.lower(F.trim(said))
    near = [F.when(t == words, F.date_add(today, n)) for words, n in NEAR_DAYS]
    # months are written with a capital
    written = [F.try_to_timestamp(F.initcap(t), F.lit(f)).cast("date") for f in FORMATS]
    return F.coalesce(*near, *written)


def clock(said: Column) -> Column:
    """struct(hour, minute) of the first time in the text: 4 PM, 4:30pm, 16:00, 16; else null."""
    t = F.lower(F.trim(said))
    part = lambda n: F.nullif(F.regexp_extract(t, TIME, n), F.lit(""))
    hour, minute, half = part(1).cast("int"), F.coalesce(part(2).cast("int"), F.lit(0)), part(3)
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return F.when(hour.isNotNull(), F.struct(hour.alias("hour"), minute.alias("minute")))


def shown(hour: Column, minute: Column) -> Column:
    """4:00 PM"""
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.concat(twelve.cast("string"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.when(hour >= 12, " PM").otherwise(" AM"))


def request(who: Column, when: Column, at: Column, today: Column) -> Column:
    """struct(doctor, specialty, day, time, slot, problem, alternatives): problem is null for a slot that can be booked."""
    d, on, t = doctor(who), day(when, today), clock(at)
    hour, minute = t["hour"], t["minute"]
    problem = (
        F.when(d.isNull(), "doctor").when(on.isNull(), "date").when(t.isNull(), "time").when(F.dayofweek(on) == 1, "sunday")
        .when((hour < OPENS) | (hour >= CLOSES), "hours").when(on < today, "past")
    )
    iso = F.coalesce(F.date_format(on, "yyyy-MM-dd"), F.lit(""))
    time = F.coalesce(F.concat_ws(":", F.lpad(hour.cast("string"), 2, "0"), F.lpad(minute.cast("string"), 2, "0")), F.lit(""))
    time = F.when(t.isNull(), "").otherwise(time)
    name = F.coalesce(d["name"], F.lit(""))
    near = F.array_compact(F.array(F.when(hour - 1 >= OPENS, shown(hour - 1, F.lit(0))), F.when(hour + 1 < CLOSES, shown(hour + 1, F.lit(0)))))
    return F.struct(
        name.alias("doctor"), F.coalesce(d["specialty"], F.lit("")).alias("specialty"), iso.alias("day"), time.alias("time"),
        F.concat_ws("|", name, iso, time).alias("slot"), problem.alias("problem"), F.array_join(near, ", ").alias("alternatives"),
    )
