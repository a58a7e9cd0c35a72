"""Small archives for tests."""

import zipfile

STOPS = '﻿stop_id,stop_name,stop_lat,stop_lon,extra\r\n1,"Markt, ""Alt""\nNord",47.5,14.0,e\r\n2,Bad,47.6\r\n3,,x,14.2,\r\n'
FILES = {
    "stops.txt": STOPS,
    "routes.txt": "route_id,route_short_name,route_type\nr1,5,3\n",
    "agency.txt": "agency_id,agency_name\na,Verkehr\n",
    "trips.txt": "route_id,service_id,trip_id,shape_id\nr1,w,t1,s1\nr1,none,t2,s1\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt1,6:00:00,6:00:00,1,1\nt1,6:09:00,6:10:00,2,2\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\n"
                    "w,1,1,1,1,1,0,0,20240101,20241231\n",
}


def pack(path, files, folder=""):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(folder + name, text.encode())
